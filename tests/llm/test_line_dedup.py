from __future__ import annotations

from pyspark.sql import functions as F

from keepline.llm.line_dedup import dedup_lines, drop_bitmaps

SPACE = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def by_hand(rows):
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, i), i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) >= i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def result(df):
    return df.select("original.doc_id", "n_lines", "n_dropped", "kept").collect()


def test_against_brute_force(docs, rows):
    want = by_hand(rows)
    got = result(dedup_lines(docs))
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == want
    assert sum(n for _, n, _ in want.values()) > 10


def test_one_slice_or_many_give_the_same(docs):
    one, many = (sorted(map(tuple, result(dedup_lines(docs, slices=n)))) for n in (1, 97))
    assert one == many


def test_bitmaps_hold_only_words_with_dropped_lines(docs):
    for r in drop_bitmaps(docs).collect():
        assert all(w.bits != 0 for w in r.bitmap)
        assert [w.word for w in r.bitmap] == sorted({w.word for w in r.bitmap})


def test_many_lines_in_one_document(spark):
    lines = [f"line number {i} of many" for i in range(700)]
    docs = spark.createDataFrame([(1, "\n".join(lines[::3])), (2, "\n".join(lines))], "doc_id long, text string")
    got = {r.doc_id: r for r in result(dedup_lines(docs))}
    assert got[1].n_dropped == 0
    assert got[2].kept.split("\n") == [x for i, x in enumerate(lines) if i % 3]


def test_odd_rows(odd_docs):
    got = dedup_lines(odd_docs)
    back = got.select("original.*", "n_lines", "n_dropped", "kept")
    assert back.columns[: len(odd_docs.columns)] == odd_docs.columns
    out = sorted((r.doc_id or 0, r.text or "", r.n_dropped, r["kept"]) for r in got.select("original.doc_id", "original.text", "n_dropped", "kept").collect())
    assert len(out) == 8
    # without an id nothing is lost and nothing is held; texts of one id don't compete
    assert [x[2] for x in out] == [0, 0, 0, 0, 1, 0, 0, 0]


def test_empty_table(no_docs):
    assert dedup_lines(no_docs).count() == 0
    assert drop_bitmaps(no_docs).agg(F.count("*")).first()[0] == 0


def test_negative_ids_come_first(spark):
    line = "the same line of text"
    rows = [(i, f"{line}\nonly {i} has this line") for i in (3, -5, 0, -9, 12)]
    got = result(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == by_hand(rows)
    assert [r.doc_id for r in got if r.n_dropped == 0] == [-9]
