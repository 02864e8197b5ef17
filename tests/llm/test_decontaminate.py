from __future__ import annotations

import re

from keepline.llm.decontaminate import decontaminate, item_windows


def words(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(rows, items):
    out = {}
    for i, text in rows:
        ws, hit, found = words(text), set(), set()
        for item, t in items:
            w = words(t)
            width = min(len(w), 13)
            for k in range(len(w) - width + 1 if w else 0):
                for s in range(len(ws) - width + 1):
                    if ws[s : s + width] == w[k : k + width]:
                        hit |= set(range(s, s + width))
                        found.add(str(item))
        out[i] = (len(ws), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(ws))
    return out


def sample(rows):
    texts = [t for _, t in rows if t and 20 < len(t.split()) < 200]
    items = [(7, " ".join(texts[0].upper().split()[:17])), (10, " -- ".join(texts[1].split()[2:16])), (2, "the, ab"), (3, None), (4, "...")]
    return [*items, (5, " ".join(texts[0].split()[3:17])), (7, " ".join(texts[0].split()[:17])), (None, " ".join(texts[2].split()[:13]))]


def test_against_brute_force(spark, docs, rows):
    items = sample(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs, bench).select("original.doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    short = [(i, t) for i, t in rows if len(t or "") < 50_000]
    want = by_hand(short, [(i, t) for i, t in items if i is not None])
    hits = by_hand(short, items)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in want:
            assert (r.n_words, r["items"]) == (want[r.doc_id][0], want[r.doc_id][2])
            assert (r.n_hit, r.contaminated) == (hits[r.doc_id][1], hits[r.doc_id][3])
    assert sum(x[3] for x in hits.values()) >= 3


def test_beyond_the_size_bound_the_result_is_the_same(spark, docs, rows):
    bench = spark.createDataFrame(sample(rows), "item_id long, text string")
    one, other = (
        sorted((r.original.doc_id, r.n_hit, r.cleaned or "") for r in decontaminate(docs, bench, most_bytes=n).collect())
        for n in (0, 1 << 30)
    )
    assert one == other


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Oh: alpha beta, GAMMA! delta"), (2, "alpha gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    got = {r.original.doc_id: r for r in decontaminate(docs, bench).collect()}
    assert (got[1].cleaned, got[1].n_hit) == ("Oh: alpha delta", 2)
    assert (got[2].cleaned, got[2].contaminated) == ("alpha gamma", False)


def test_windows(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(15))), (2, "short one"), (3, ""), (4, None)]
    got = item_windows(spark.createDataFrame(rows, "item_id long, text string")).collect()
    assert sorted((r.width, r["items"]) for r in got) == [(2, ["2"]), (13, ["1"]), (13, ["1"]), (13, ["1"])]


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the same line here")], "item_id long, text string")
    got = decontaminate(odd_docs, bench)
    assert got.select("original.*").columns == odd_docs.columns
    assert got.where("contaminated").count() == 3
    assert decontaminate(no_docs, bench).count() == 0
    none = decontaminate(odd_docs, bench.limit(0)).select("n_hit", "items", "contaminated").distinct().collect()
    assert [tuple(r) for r in none] == [(0, [], False)]
