from __future__ import annotations

import random

from pyspark.sql import functions as F

from keepline.llm.chat import escape, format_chats, read_loss, read_turns, unescape

BITS = ["\\", "#", "### ", "assistant\n", "</turn>", "<", "\\b", "\\l", "\\h", "\n", "é", "ok", " ", "\\\\", ""]


def conversations(seed: int = 2):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "we\nird#", None])
            text = None if rng.random() < 0.1 else "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))
            rows.append((conv, turn if rng.random() < 0.9 else None, role, text))
    rng.shuffle(rows)
    return rows


def test_round_trip_and_mask(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = format_chats(df).select(
        "conv_id", "formatted", "mask", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("mask")).alias("loss")
    ).collect()
    assert len(got) == 60
    for r in got:
        turns = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        want = [(x[2], x[3]) for x in turns]
        assert [tuple(x) for x in r.t] == want
        assert r.loss == "".join(text for role, text in want if role == "assistant")
        assert sum(m.length for m in r["mask"]) == len(r.formatted)
        heads = sum(i == 0 or want[i][0] != want[i - 1][0] for i in range(len(want)))
        assert r.formatted.count("### ") == heads and r.formatted.count("</turn>") == len(want)
        at, under = 0, []
        for m in r["mask"]:
            under.append(r.formatted[at : at + m.length] if m.loss else "")
            at += m.length
        plain = "".join(under).replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\")
        assert plain == r.loss


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", escape(F.col("text")).alias("e"), unescape(escape(F.col("text"))).alias("u")).collect():
        assert r.u == r.text and "<" not in r.e and "#" not in r.e


def test_many_turns(spark):
    df = spark.range(5000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("x").alias("text")
    )
    r = format_chats(df).select(F.size(read_turns(F.col("formatted"))).alias("n"), read_loss(F.col("formatted"), F.col("mask")).alias("loss")).first()
    assert (r.n, len(r.loss)) == (5000, 3333)


def test_null_ids_extra_columns_and_empty_table(spark):
    rows = [(None, 1, "user", "a", "x"), (None, 1, "user", "a", "y"), (4, 1, "assistant", "b", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask string")
    got = {r.conv_id: r.formatted for r in format_chats(df).collect()}
    assert got == {None: "### user\na</turn>a</turn>\n", 4: "### assistant\nb</turn>\n"}
    assert format_chats(df.limit(0)).count() == 0
