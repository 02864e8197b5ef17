from __future__ import annotations

import random

import numpy as np
import xxhash

from keepline.llm import simhash as S
from keepline.llm.components import components


def by_hand(text: str | None, width: int = 4) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps: dict[int, int], distance: int) -> dict[int, int]:
    root = {i: i for i in fps}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_spark_hashes_alike(spark):
    row = spark.sql("SELECT xxhash64('one two') AS h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"one two", 42)


def test_against_brute_force(docs, rows):
    fps = {i: by_hand(t) for i, t in rows}
    want = groups(fps, 4)
    got = {r.doc_id: r for r in S.simhash_groups(docs).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(want) - 15


def test_links_of_close_fingerprints(spark):
    """Chains of close values, a dense cloud and noise, for several distances."""
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            for b in rng.sample(range(64), 3):
                x ^= 1 << b
            values.add(x)
    middle = rng.getrandbits(64)
    values |= {middle ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(30)}
    fps = dict(enumerate(sorted(values)))
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in fps.items()]
    table = spark.createDataFrame(rows, "doc long, fp long")
    for distance in (0, 1, 4):
        want = groups(fps, distance)
        roots = {r.node: r.root for r in components(S.links(table, distance)).collect()}
        mine = {}
        for i, f in rows:
            mine.setdefault(roots.get(f, f), []).append(i)
        assert sorted(sorted(g) for g in mine.values()) == sorted(
            sorted(i for i in want if want[i] == r) for r in set(want.values())
        )


def test_large_buckets_are_not_listed_pair_by_pair():
    rng = np.random.default_rng(2)
    base = np.uint64(rng.integers(0, 1 << 63))
    flips = rng.integers(0, 1 << 12, 3000).astype(np.uint64)
    fps = np.unique(base ^ flips)
    a, b = S._spread(fps, 4)
    assert len(a) < len(fps)
    assert (np.bitwise_count(a ^ b) <= 4).all()


def test_thresholds_meet_the_pigeonhole_sum():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 1] = bits[:, 0]
    both = bits.T @ bits
    for parts in (1, 2, 3, 4):
        grouped = S.group_bits(500, both, parts)
        assert sorted(b for g in grouped for b in g) == list(range(64))
        assert any({0, 1} <= set(g) for g in grouped)
        _, thresholds = S.allocate(500, both, grouped, 4)
        assert sum(thresholds) == 4 - parts + 1
    few = S.plan(500, both, 4)
    many = S.plan(10**9, both * 2 * 10**6, 4)
    assert sum(len(f) for _, _, f in few) <= sum(len(f) for _, _, f in many)


def pairs_within(values: np.ndarray, mask: int, most: int) -> float:
    near = sum(int((np.bitwise_count((values ^ v) & np.uint64(mask)) <= most).sum()) - 1 for v in values)
    return near / (len(values) * (len(values) - 1))


def test_measured_shares_follow_correlated_bits(spark):
    """16 bits that mostly go together: the share of equal keys is measured, not multiplied out."""
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, (3000, 64))
    lead = rng.integers(0, 2, 3000)
    bits[:, :16] = np.where(rng.random((3000, 16)) < 0.1, 1 - lead[:, None], lead[:, None])
    values = np.unique(np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel())
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(5)
    n, both = S.bit_counts(table)
    groups = S.group_bits(n, both, 4)
    assert list(range(16)) in groups
    queries = S.query_values(table, n)
    assert len(queries) == S.QUERIES and set(queries) <= set(values)
    shares = S.measured_shares(table, n, queries, groups, 4)
    for group in groups:
        for most in (0, 2, 4):
            true = pairs_within(values, S.mask_of(group), most)
            if true > 1e-4:
                assert true / 2 < shares[S.mask_of(group)][most] < 2 * true
    assert S.candidate_shares(n, both, list(range(16)), 4)[0] < shares[S.mask_of(list(range(16)))][0] / 100
    assert len(S.query_values(table, n, 5000)) == n  # fewer values than asked for: all of them


def test_one_bucket_of_unrelated_values_is_split():
    """Noise, near pairs, chains and one dense cloud under a common key: components as by brute force."""
    rng = np.random.default_rng(6)
    noise = rng.integers(0, 1 << 52, 6000).astype(np.uint64)
    near = noise[:300] ^ (np.uint64(1) << rng.integers(0, 52, 300).astype(np.uint64))
    chain = [noise[0]]
    for _ in range(60):
        chain.append(chain[-1] ^ (np.uint64(15) << np.uint64(rng.integers(0, 48))))
    cloud = noise[1] ^ rng.integers(0, 1 << 10, 400).astype(np.uint64)
    values = np.unique(np.concatenate([noise, near, np.array(chain, dtype=np.uint64), cloud]))
    for distance in (0, 1, 4):
        a, b = S._spread(values, distance)
        assert (np.bitwise_count(a ^ b) <= distance).all()
        every = [(v, w) for i, v in enumerate(values) for w in values[i + 1 :][S._close(values[i + 1 :], v, distance)]]
        want = np.array(every, dtype=np.uint64).reshape(-1, 2)
        mine, theirs = (dict(zip(*S.local_roots(x, y))) for x, y in ((a, b), want.T))
        assert mine == theirs


def test_values_in_one_bucket_take_less_than_all_pairs():
    import time

    def seconds(n: int) -> float:
        values = np.random.default_rng(7).integers(0, 1 << 51, n).astype(np.uint64)
        start = time.perf_counter()
        S._spread(values, 4)
        return time.perf_counter() - start

    seconds(2_000)
    assert seconds(160_000) < 8 * max(seconds(40_000), 0.2)  # all pairs: 16 times


def test_odd_rows(odd_docs):
    got = S.simhash_groups(odd_docs).collect()
    assert len(got) == 8
    assert [r.component_id for r in got if r.doc_id == 2] == [1]
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {(r.doc_id, r.component_id) for r in zero} == {(None, 6), (6, 6)}


def test_negative_ids(spark):
    rows = [(-5, "one two three four five"), (3, "one two three four five"), (-9, "another text of words"), (-2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in S.simhash_groups(docs).collect()}
    assert got == {-5: -5, 3: -5, -9: -9, -2: -2}


def test_empty_table(no_docs):
    assert S.simhash_groups(no_docs).count() == 0
