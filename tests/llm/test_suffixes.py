from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from keepline.llm import suffixes as S


def by_hand(rows, length=50):
    """(n_bytes, spans, digest) per row; rows are (order, text) and equal orders are one document."""
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans, at = [], 0
        while (start := gone.find(1, at)) >= 0:
            end = gone.find(0, start)
            at = end if end >= 0 else len(b)
            spans.append((start, at))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256) for r in df.collect())


def test_against_brute_force(docs, rows):
    want = sorted((i, *x) for (i, _), x in zip(rows, by_hand(rows)))
    assert sum(len(x[2]) for x in want) > 20
    for bucket in (1 << 30, 1 << 13):
        assert result(S.repeated_spans(docs, bucket_bytes=bucket)) == want


def test_overlaps_and_periodic_texts(spark):
    rng = random.Random(7)
    pool = ["".join(rng.choice("abc") for _ in range(90)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [rng.choice(pool)[rng.randrange(30) : 60 + rng.randrange(30)] for _ in range(rng.randint(1, 4))]
        parts.append(rng.choice(["ab" * 60, "x" * 70, "é" * 40, "", "abc" * rng.randint(10, 40)]))
        rng.shuffle(parts)
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(S.repeated_spans(df)) == sorted((i, *x) for (i, _), x in zip(rows, by_hand(rows)))
    assert result(S.repeated_spans(df, length=32)) == sorted((i, *x) for (i, _), x in zip(rows, by_hand(rows, 32)))


def test_pieces_of_long_texts(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 1000)
    monkeypatch.setattr(S, "PIECE", 700)
    want = by_hand(rows)
    numbered = [(i, (t or "").encode()) for i, t in rows]

    class Batch:
        def column(self, i):
            return [Column([x[0] for x in numbered]), Column([x[1] for x in numbered])][i]

    class Column(list):
        def to_pylist(self):
            return self[:]

        def __iter__(self):
            return iter([type("V", (), {"as_py": lambda self, v=v: v})() for v in list.__iter__(self)])

    chunks = list(S._chunks([Batch()], 50))
    starts = {(d, k) for c in chunks for d, lo, hi in zip(c["doc"], c["lo"], c["hi"]) for k in range(lo, lo + hi + 1)}
    assert starts == {(i, k) for i, b in numbered for k in range(len(b) - 49)}
    assert len(want) == len(rows)


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(1)
    one = rng.integers(97, 100, 400, dtype=np.uint8)
    other = np.concatenate([rng.integers(97, 123, 37, dtype=np.uint8), one[50:350], rng.integers(97, 123, 41, dtype=np.uint8)])
    a = S.anchored(one, np.array([0]), np.array([len(one)]))
    b = S.anchored(other, np.array([0]), np.array([len(other)]))

    def places(x, offset):
        return {k + offset: at + offset for lo, hi, at in zip(x["lo"], x["hi"], x["at"]) for k in range(lo, hi + 1)}

    left, right = places(a, 0), places(b, 13)
    assert all(left[k] == right[k] for k in range(50, 301))


def test_multikey_sort():
    rng = np.random.default_rng(5)
    keys = [rng.integers(0, 5, 400).astype(np.uint64) for _ in range(4)]
    order, news = S.multikey_sort(keys)
    rows = list(zip(*[k[order].tolist() for k in keys]))
    assert rows == sorted(rows)
    for depth, new in enumerate(news, start=1):
        assert new.tolist() == [i == 0 or rows[i][:depth] != rows[i - 1][:depth] for i in range(400)]


def test_columns_survive_packing():
    rng = np.random.default_rng(6)
    rows = {c: rng.integers(0, 1 << min(8 * n, 62), 50) for c, n in S.COLUMNS.items()}
    back = S._unpacked(S._packed(rows, S.SENT), S.SENT)
    assert all((back[c].astype(np.int64) == rows[c]).all() for c in rows)


def test_odd_rows(odd_docs):
    got = S.repeated_spans(odd_docs).collect()
    assert len(got) == 8
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    assert sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in got if r.doc_id in (1, 2)) == [
        (1, []), (1, []), (2, [(0, len(text))])
    ]


def test_other_ids_and_empty_table(spark, no_docs, rows):
    short = [(f"k{i:03d}", t) for i, t in rows if len(t or "") < 20_000]
    df = spark.createDataFrame(short, "doc_id string, text string")
    assert result(S.repeated_spans(df)) == sorted((i, *x) for (i, _), x in zip(short, by_hand(short)))
    assert S.repeated_spans(no_docs).count() == 0
    with pytest.raises(ValueError):
        S.repeated_spans(no_docs, length=10)


@pytest.mark.parametrize("parts", [1, 6])
def test_negative_ids_come_first(spark, rows, parts):
    """Ids on both sides of zero, the smallest one included, whatever the tasks that read them."""
    some = [(i, t) for i, t in rows if len(t or "") < 20_000]
    signed = [(-(1 << 63) if k == 0 else (-1) ** k * i, t) for k, (i, t) in enumerate(some)]
    signed += [(-5000, "the same long text of two documents, again " * 9), (3000, "the same long text of two documents, again " * 9)]
    signed.sort()
    df = spark.createDataFrame(signed, "doc_id long, text string").repartition(parts)
    assert result(S.repeated_spans(df)) == sorted((i, *x) for (i, _), x in zip(signed, by_hand(signed)))


def test_long_periodic_documents(spark):
    """Texts of one repeated unit: every place is an anchor, and all of the later document goes."""
    base = [(-2, "ab" * 40_000), (4, "b" + "ab" * 30_000), (9, "-" * 50_000), (7, "-" * 60_000), (8, "x" + "-" * 49)]
    base.sort()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in S.repeated_spans(spark.createDataFrame(base, "doc_id long, text string").repartition(3)).collect()}
    assert got == {-2: [], 4: [(0, 60_001)], 7: [], 8: [], 9: [(0, 50_000)]}
