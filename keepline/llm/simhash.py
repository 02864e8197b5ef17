"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that go together are grouped into partitions; dynamic programming gives each partition its own
threshold so that probes plus estimated candidates are fewest; fingerprints meet where a partition
agrees within its threshold, and meeting pairs are verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.llm.common import field, same_partitions, stored, type_of
from keepline.llm.components import components, local_roots

BITS = 64
SEED = 42
SHINGLE = 4
MAX_DISTANCE = 4
LARGE = 256
CHUNK = 1 << 18
QUERIES = 256
MOST_LINKS = 1 << 22


def shingle_hashes(text: str | bytes | None, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, in blocks; A-Z lower-cased, words cut at ASCII white space."""
    if not text:
        return
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    if not words:
        return
    if len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    joined, at = b" ".join(words), 0
    starts, ends = [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(words) - width + 1, CHUNK):
        some = zip(starts[i : i + CHUNK], ends[i + width - 1 : i + width - 1 + CHUNK])
        yield np.array([digest(joined[a:b], SEED) for a, b in some], dtype=np.uint64)


def fingerprint(text: str | bytes | None, width: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingle hashes; no words: zero."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, width):
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp): one row per row of docs; fp is the fingerprint as a signed long."""
    kind = type_of(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc", "fp"])

    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([field("doc", kind), field("fp", T.LongType())]))


# ---- partitions and thresholds


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often bits i and j are both set, over all fingerprints: 64 x 64 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(fp.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            both += bits.T @ bits
            n += len(fp)
        i, j = np.meshgrid(range(BITS), range(BITS), indexing="ij")
        cells = np.concatenate([both.ravel(), [n]]).astype(np.int64)
        names = np.concatenate([(i * BITS + j).ravel(), [BITS * BITS]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(cells)], ["cell", "n"])

    total = np.zeros(BITS * BITS + 1)
    for r in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r["cell"]] = r["n"]
    return int(total[-1]), total[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal width; each group takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        rest = sorted(left)
        inside = corr[np.ix_(rest, rest)].copy()
        np.fill_diagonal(inside, 0)
        group = [rest[int(inside.sum(axis=1).argmax())]]
        while len(group) < width:
            others = [b for b in rest if b not in group]
            group.append(others[int(corr[np.ix_(others, group)].mean(axis=1).argmax())])
        left -= set(group)
        groups.append(sorted(group))
    return groups


def mask_of(group: list[int]) -> int:
    return sum(1 << b for b in group)


def query_values(fps: DataFrame, n: int, most: int = QUERIES) -> np.ndarray:
    """At most `most` of n distinct fingerprints, the first in the order of a hash; the driver gets about
    twice as many, however many tasks there are."""
    order = F.xxhash64(F.lit(SEED), "fp")
    share = 2 * most / max(n, 1)
    while True:
        below = fps.select("fp", order.alias("o"))
        if share < 1:
            below = below.where(F.col("o") < F.lit(int(share * 2**64) - 2**63))
        rows = below.orderBy("o", "fp").limit(most).collect()
        if share >= 1 or len(rows) >= most:
            return np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64)
        share *= 2


def measured_shares(
    fps: DataFrame, n: int, queries: np.ndarray, groups: list[list[int]], distance: int
) -> dict[int, list[float]]:
    """By mask of a group: share of all fingerprints within 0, 1, .. distance bits of another one in it.

    Counted between the query values and every fingerprint, so bits that go together are taken as they are.
    """
    masks = sorted({mask_of(g) for g in groups})
    width = distance + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros((len(masks), width), dtype=np.int64)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), 4096):
                apart = every[i : i + 4096, None] ^ queries[None, :]
                other = apart != 0
                for m, mask in enumerate(masks):
                    bits = np.bitwise_count(apart & np.uint64(mask))
                    near[m] += [np.count_nonzero((bits <= r) & other) for r in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(near.size, dtype=np.int32)), pa.array(near.ravel())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(masks) * width)
    for r in rows:
        total[r["cell"]] = r["n"]
    pairs = max(len(queries) * (n - 1), 1)
    return {m: list(x) for m, x in zip(masks, total.reshape(-1, width) / pairs)}


def candidate_shares(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """The same share as it were if the bits of a group were independent; used where none is measured."""
    p = np.diag(both)[group] / max(n, 1)
    exactly = np.zeros(len(group) + 1)
    exactly[0] = 1
    for d in 2 * p * (1 - p):
        exactly[1:] = exactly[1:] * (1 - d) + exactly[:-1] * d
        exactly[0] *= 1 - d
    return [float(x) for x in np.cumsum(exactly)[: most + 1]]


def allocate(
    n: int, both: np.ndarray, groups: list[list[int]], distance: int, measured: dict[int, list[float]] | None = None
) -> tuple[float, list[int]]:
    """Thresholds that sum to distance - parts + 1 and cost least; -1 leaves a group unprobed."""
    target = distance - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        shares = measured[mask_of(group)] if measured else candidate_shares(n, both, group, distance)
        cost = {-1: 0.0}
        for t in range(distance + 1):
            probes = sum(comb(len(group), r) for r in range(min(t, len(group)) + 1))
            cost[t] = 20.0 * probes + n * shares[min(t, len(shares) - 1)]
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t, c in cost.items():
                if total + t not in step or spent + c < step[total + t][0]:
                    step[total + t] = (spent + c, [*chosen, t])
        best = step
    return best[target]


def groupings(n: int, both: np.ndarray, distance: int) -> list[list[list[int]]]:
    """The ways to cut the bits that are tried: into 1 to distance + 1 groups."""
    return [group_bits(n, both, parts) for parts in range(1, distance + 2)]


def plan(
    n: int, both: np.ndarray, distance: int, measured: dict[int, list[float]] | None = None
) -> list[tuple[int, int, list[int]]]:
    """(bits as a mask, threshold, flips to probe) of each probed partition, for the cheapest grouping."""
    choices = []
    for parts, groups in enumerate(groupings(n, both, distance), start=1):
        cost, thresholds = allocate(n, both, groups, distance, measured)
        choices.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(choices, key=lambda c: c[:2])
    made = []
    for group, t in zip(groups, thresholds):
        if t >= 0:
            flips = [sum(1 << b for b in some) for r in range(t + 1) for some in combinations(group, r)]
            made.append((mask_of(group), t, flips))
    return made


# ---- probe and verify


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


class _Edges:
    """Links found so far; many of them are replaced by the stars of their components."""

    def __init__(self) -> None:
        self.froms, self.tos, self.n = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.froms.append(a)
        self.tos.append(b)
        self.n += len(a)
        if self.n > MOST_LINKS:
            a, b = local_roots(*self.all())
            self.froms, self.tos, self.n = [a], [b], 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.froms), np.concatenate(self.tos)


def _walk(values: np.ndarray, distance: int, edges: _Edges, whole: bool) -> np.ndarray:
    """Breadth first over distinct values, each compared only with those that no component has taken yet.

    Unless `whole`, it stops when 64 comparisons in a row took less than a quarter of what was left, and
    returns the values whose links are not all found.
    """
    left, wave, steps, before = values, values[:0], 0, len(values)
    while len(left):
        if not len(wave):
            wave, left = left[:1], left[1:]
        pivot, wave = wave[0], wave[1:]
        near = _close(left, pivot, distance)
        found, left = left[near], left[~near]
        edges.add(np.full(len(found), pivot, dtype=np.uint64), found)
        wave = np.concatenate([wave, found])
        steps += 1
        if steps % 64 == 0 and len(left) > LARGE and not whole:
            if 4 * len(left) > 3 * before:
                return np.concatenate([wave, left])
            before = len(left)
    return left


def _split(values: np.ndarray, distance: int, edges: _Edges) -> Iterator[np.ndarray]:
    """Pigeonhole on the bits that vary: values within `distance` bits agree in one of distance + 1 groups
    of them. Small runs of equal groups are compared here, large ones come back."""
    bits = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, BITS)
    ones = bits.sum(axis=0, dtype=np.int64)
    uneven = np.abs(2 * ones - len(values))
    vary = [int(b) for b in np.argsort(uneven, kind="stable") if 0 < ones[b] < len(values)]
    for k in range(distance + 1):
        key = values & np.uint64(mask_of(vary[k :: distance + 1]))
        order = np.argsort(key, kind="stable")
        key, held = key[order], values[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[first, len(key)])
        ends = np.repeat(np.where(sizes <= LARGE, first + sizes, 0), sizes)
        live, j = np.arange(len(held)), 1
        while len(live := live[live + j < ends[live]]):
            hit = live[_close(held[live], held[live + j], distance)]
            edges.add(held[hit], held[hit + j])
            j += 1
        for g in np.flatnonzero(sizes > LARGE):
            yield held[first[g] : first[g] + sizes[g]]


def _spread(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold one large bucket's components together, without listing its pairs.

    Close values are walked; what hardly links is split by its other bits, and so are the parts. A part
    that a split leaves with over an eighth of the values is walked to its end instead.
    """
    edges, todo = _Edges(), [(np.unique(fps), False)]
    while todo:
        values, whole = todo.pop()
        rest = _walk(values, distance, edges, whole or len(values) <= LARGE)
        if len(rest):
            todo += [(part, 8 * len(part) > len(rest)) for part in _split(rest, distance, edges)]
    return edges.all()


def _bucket_links(part: np.ndarray, key: np.ndarray, fp: np.ndarray, masks: np.ndarray, distance: int):
    """Verified links within whole buckets; rows are sorted by part and key."""
    first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
    sizes = np.diff(np.r_[first, len(key)])
    bucket = np.repeat(np.arange(len(first)), sizes)
    home = (fp & masks[part]) == key  # rows that hold the key itself; the others probe
    order = np.lexsort((~home, bucket))
    fp, home = fp[order], home[order]
    homes = np.bincount(bucket, weights=home, minlength=len(first)).astype(np.int64)
    froms, tos = [], []
    live = np.flatnonzero((homes[bucket] > 0) & (sizes[bucket] > 1) & (sizes[bucket] <= LARGE))
    j = 0
    while len(live):
        other = fp[first[bucket[live]] + j]
        hit = _close(fp[live], other, distance) & (fp[live] != other)
        froms.append(other[hit])
        tos.append(fp[live][hit])
        j += 1
        live = live[homes[bucket[live]] > j]
    for g in np.flatnonzero((sizes > LARGE) & (homes > 0)):
        a, b = _spread(fp[first[g] : first[g] + sizes[g]], distance)
        froms.append(a)
        tos.append(b)
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *froms]), np.concatenate([none, *tos])


def links(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b), a > b: edges that hold together all fingerprints reachable by steps of `distance` bits.

    fps has distinct values in `fp`. Every linked pair meets in at least one bucket. Edges are the
    stars of what a task has found, so a group of n near copies gives about n edges, not n squared.
    """
    n, both = bit_counts(fps)
    groups = [g for some in groupings(n, both, distance) for g in some]
    probes = plan(n, both, distance, measured_shares(fps, n, query_values(fps, n), groups, distance))
    masks = np.array([m for m, _, _ in probes], dtype=np.uint64)
    flips = [np.array(f, dtype=np.uint64) for _, _, f in probes]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(every), 4096):
                fp = every[i : i + 4096]
                for part, (mask, flip) in enumerate(zip(masks, flips)):
                    key = ((fp & mask)[:, None] ^ flip[None, :]).ravel()
                    held = np.repeat(fp, len(flip))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(key), part, dtype=np.int8)),
                            pa.array(key.view(np.int64)),
                            pa.array(held.view(np.int64)),
                        ],
                        ["part", "key", "fp"],
                    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=t) for t in (np.int8, np.uint64, np.uint64)]

        def found(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = local_roots(*_bucket_links(*rows, masks, distance)) if len(rows[0]) else (kept[1][:0], kept[1][:0])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cols = [cols[0], cols[1].view(np.uint64), cols[2].view(np.uint64)]
            rows = [np.concatenate([k, c]) for k, c in zip(kept, cols)]
            if not len(rows[0]):
                continue
            last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1:].sum() + 1)
            if rows[0][0] == rows[0][-1] and rows[1][0] == rows[1][-1]:
                last = 0
            kept = [r[last:] for r in rows]
            if last:
                yield found([r[:last] for r in rows])
        if len(kept[0]):
            yield found(kept)

    probed = fps.select("fp").mapInArrow(probe, "part byte, key long, fp long")
    return same_partitions(probed, "part", "key").mapInArrow(verify, "a long, b long").distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = MAX_DISTANCE,
) -> DataFrame:
    """(id, fingerprint, component_id), one row per row of docs.

    Fingerprints are linked at `distance` or fewer differing bits; component_id is the smallest id
    reachable by such links. A null text has no words and, like an empty one, fingerprint zero.
    Repeated rows repeat in the result. A null id takes part in links but is never the smallest; a
    component without any id has component_id null. Ids may be negative; equal fingerprints are one
    value, so ties don't arise. A text of any length is hashed in blocks. No rows give no rows. Other
    columns are not looked at, whatever their names.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle))
    ids = stored(rows.groupBy("fp").agg(F.min("doc").alias("first_doc")))
    roots = components(links(ids, distance))
    named = ids.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
