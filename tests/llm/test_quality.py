from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from keepline.llm import quality as Q


def by_hand(text: str | None) -> tuple[int, ...]:
    text = text or ""
    flat = text
    for c in "\t\n\x0b\x0c\r":
        flat = flat.replace(c, " ")
    words = [w for w in flat.split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            again |= set(range(i, i + 5))
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), len(lines)


def test_counts_against_brute_force(docs, rows):
    got = {r.doc: tuple(r)[1:] for r in Q.rule_counts(docs).collect()}
    for i, t in rows:
        if len(t or "") < 20_000:
            assert got[i] == by_hand(t)
        else:
            assert got[i][0] == len(t.split())


def test_counts_of_repetitive_texts():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "é ", "# ", " \n"]) for _ in range(rng.randint(0, 60)))
        assert Q.counts_of(text.encode()) == by_hand(text)


def test_path_lengths_by_walking():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    forest = Q.grow([x[rng.choice(400, 64, False)] for _ in range(10)])
    want = []
    for row in x[:50]:
        total = 0.0
        for at in forest.roots:
            while forest.column[at] >= 0:
                at = forest.child[at] + (row[forest.column[at]] >= forest.value[at])
            total += forest.length[at]
        want.append(2 ** (-total / 10 / Q.expected_length(64)))
    assert np.allclose(forest.score(x[:50]), want)
    assert forest.score(np.full((1, 3), 9.0))[0] > np.quantile(forest.score(x), 0.98)


def table(spark, n: int = 900):
    """Every ninth document is junk; labels tell for some of them."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        junk = i % 9 == 0
        words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) + ("$$%" if junk else "") for _ in range(rng.randint(30, 90))]
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(not junk)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = table(spark)
    held_out = {r.doc_id: r for r in Q.quality_rules(docs, labels).collect() if r.doc_id % 2 == 0}
    junk = [r for i, r in held_out.items() if i % 9 == 0]
    clean = [r for i, r in held_out.items() if i % 9]
    assert sum(not r.kept for r in junk) >= 0.95 * len(junk)
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)


def test_same_result_for_any_partitioning(spark):
    docs, labels = table(spark, 300)
    one, other = (sorted(map(tuple, Q.quality_rules(docs.repartition(n), labels).collect())) for n in (1, 7))
    assert one == other


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    _, labels = table(spark, 30)
    odd = labels.unionAll(spark.createDataFrame([(None, 0), (2, None), (2, 7), (1, 0), (1, 1)], labels.schema))
    got = Q.quality_rules(odd_docs, odd).collect()
    assert len(got) == 8
    assert {r.base_failed for r in got if r.n_words < 10} == {True}
    assert not any(r.kept for r in got if r.base_failed)
    assert Q.quality_rules(no_docs, odd).count() == 0
    everything = Q.quality_rules(odd_docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in everything)


def test_sample_is_bounded_over_many_partitions(spark):
    """600 partitions: the rows first in hash order, whatever the partitions, and few more are sent."""
    names = Q.COUNTS
    rows = spark.range(0, 60_000, 1, 600).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc"),
        *[F.when(F.col("id") % 3 > 0, F.col("id") % (7 + i)).otherwise(5).cast("long").alias(c) for i, c in enumerate(names)],
    )
    for need in (100, 30_000, 100_000):
        got = Q.lowest_rows(rows, need)
        order = F.xxhash64(F.lit(Q.SEED), "doc", *names)
        want = sorted(tuple(r) for r in rows.coalesce(4).select(order, *names).collect())[:need]
        assert got.tolist() == [list(r[1:]) for r in want]
    assert rows.rdd.getNumPartitions() == 600


def test_equal_scores_share_their_fate(spark):
    """Ties: documents of equal counts have equal scores, so all or none lie above the cut."""
    rows = [(i, f"word{'x' * (i % 5)} " * 20 + " ".join(f"w{j}" for j in range(i % 5, 40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(300)], "doc_id long, quality int")
    got = Q.quality_rules(docs, labels).collect()
    fate = {}
    for r in got:
        fate.setdefault(tuple(r[c] for c in Q.COUNTS), set()).add((r["anomaly"], r["kept"]))
    assert all(len(f) == 1 for f in fate.values())
