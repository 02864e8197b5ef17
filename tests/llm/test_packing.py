from __future__ import annotations

import random
from collections import defaultdict

from keepline.llm.packing import best_fit, pack


def plain(sizes, sources, groups, capacity):
    """Best fit by looking at every bin."""
    bins = []
    out = []
    for n, s, g in zip(sizes, sources, groups):
        fits = [
            (b["room"], k)
            for k, b in enumerate(bins)
            if b["room"] >= n and (s is None or s not in b["sources"]) and (g is None or g not in b["groups"])
        ]
        if fits:
            k = min(fits)[1]
        else:
            bins.append({"room": capacity, "sources": set(), "groups": set()})
            k = len(bins) - 1
        bins[k]["room"] -= n
        bins[k]["sources"].add(s)
        bins[k]["groups"].add(g)
        out.append(k)
    return out


def test_against_looking_at_every_bin():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 80)
        sizes = [rng.randint(0, 30) for _ in range(n)]
        if rng.random() < 0.7:
            sizes.sort(reverse=True)
        sources = [rng.choice([None, "a", "a", "a", "b", "c", "d"]) for _ in range(n)]
        groups = [rng.choice([None, 1, 2, 3, 4, 5, 6]) for _ in range(n)]
        assert best_fit(sizes, sources, groups, 30) == plain(sizes, sources, groups, 30)


def check(packed, rows, capacity):
    """Nothing lost, bins full at most, pieces side by side, conflicts kept."""
    tokens = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    text = {i: tuple((t or "").lower().split()) for i, t, _ in rows}
    bins, docs = defaultdict(list), defaultdict(int)
    for r in packed:
        bins[r.bin].append(r)
        docs[r.doc_id] += r.n_tokens
    assert docs == tokens
    for inside in bins.values():
        inside.sort(key=lambda r: r.place)
        assert [r.place for r in inside] == list(range(len(inside)))
        assert [r.start for r in inside] == [sum(x.n_tokens for x in inside[:k]) for k in range(len(inside))]
        assert sum(r.n_tokens for r in inside) <= capacity
        used = [source[r.doc_id] for r in inside if source[r.doc_id]]
        assert len(used) == len(set(used))
        copies = [text[r.doc_id] for r in inside if text[r.doc_id]]
        assert len(copies) == len(set(copies))


def test_pack(docs, rows):
    full = [(i, t, f"src{i % 3}" if i % 7 else None) for i, t in rows]
    for block in (8192, 20, 1):
        check(pack(docs, capacity=100, block=block).collect(), full, 100)


def test_blocks_of_repeated_ids_stay_bounded(spark):
    docs = spark.createDataFrame([(1, "a b c", None)] * 50 + [(None, "d", "s")] * 5, "doc_id long, text string, source string")
    got = pack(docs, capacity=10, block=4).collect()
    assert len(got) == 55
    assert len({(r.bin, r.place) for r in got}) == 55


def test_odd_rows_and_empty_table(odd_docs, no_docs):
    got = pack(odd_docs).collect()
    assert len(got) == 8 and sum(r.n_tokens for r in got) == 14 * 3 + 8 + 8 + 13
    assert pack(no_docs).count() == 0
