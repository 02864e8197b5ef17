"""Best-fit packing of documents into bins of equal capacity, under conflicts.

A bin takes at most one piece of each source and of each group of copies. Bins are ordered by what
room they have left and carry bitmaps of their sources and groups; the search goes from the tightest
bin that has room to roomier ones until one is compatible.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.llm.common import ascii_lower, bound, field, stored, type_of

CAPACITY = 2048
BLOCK = 8192
WORD_GAP = r"[\x20\x09-\x0D]+"


class Bins:
    """Open bins by room left; each knows its sources and copy groups as bitmaps."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.sources: list[int] = []
        self.groups: list[int] = []
        self.rooms = 0  # bit r: some bin has room r
        self.at: dict[int, dict[int, list[int]]] = defaultdict(dict)  # room -> sources -> bins
        self.count: Counter[int] = Counter()
        self.holding: Counter[tuple[int, int]] = Counter()  # (source bit, room) -> bins

    def _put(self, b: int, room: int) -> None:
        insort(self.at[room].setdefault(self.sources[b], []), b)
        self.count[room] += 1
        self.rooms |= 1 << room
        left = self.sources[b]
        while left:
            self.holding[left & -left, room] += 1
            left &= left - 1

    def _take(self, b: int, room: int) -> None:
        bins = self.at[room][self.sources[b]]
        bins.remove(b)
        if not bins:
            del self.at[room][self.sources[b]]
        self.count[room] -= 1
        if not self.count[room]:
            self.rooms &= ~(1 << room)
        left = self.sources[b]
        while left:
            self.holding[left & -left, room] -= 1
            left &= left - 1

    def _tightest(self, size: int, source: int, group: int) -> tuple[int, int] | None:
        rest, room = self.rooms >> size, size - 1
        while rest:
            step = (rest & -rest).bit_length()
            rest >>= step
            room += step
            if source and self.holding[source, room] == self.count[room]:
                continue
            free = [
                next((b for b in bins if not self.groups[b] & group), None)
                for sources, bins in self.at[room].items()
                if not sources & source
            ]
            if (found := min((b for b in free if b is not None), default=None)) is not None:
                return found, room
        return None

    def add(self, size: int, source: int, group: int) -> int:
        """The bin that takes the piece; source and group are single bits, or 0 for none."""
        if found := self._tightest(size, source, group):
            b, room = found
            self._take(b, room)
        else:
            b, room = len(self.sources), self.capacity
            self.sources.append(0)
            self.groups.append(0)
        self.sources[b] |= source
        self.groups[b] |= group
        self._put(b, room - size)
        return b


def _bits(values: list, skip_single: bool) -> list[int]:
    """A bit for each distinct value; 0 for null and, if asked, for values that occur once."""
    seen, bits = Counter(values), {}
    return [
        0 if v is None or (skip_single and seen[v] < 2) else 1 << bits.setdefault(v, len(bits)) for v in values
    ]


def best_fit(sizes: list[int], sources: list, groups: list, capacity: int) -> list[int]:
    """The bin of each piece, in the given order."""
    bins = Bins(capacity)
    return [bins.add(*x) for x in zip(sizes, _bits(sources, False), _bits(groups, True))]


def word_count_and_group(text: Column) -> Column:
    """(n, group): how many words a text has, and a hash of them that exact copies share."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP, -1), lambda w: w != "")
    return bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.xxhash64(w).alias("group")))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    capacity: int = CAPACITY,
    block: int = BLOCK,
) -> DataFrame:
    """(id, piece, bin, place, start, n_tokens): where each piece of each document lies.

    Tokens are words. A document longer than `capacity` is cut into full pieces and a rest; one
    without words (null or empty text) is one piece of no tokens. Pieces are dealt into blocks of
    about `block` by the hash of their id, so no source gathers in one block, and each block is
    packed by itself, largest first. A block that repeated ids make larger is packed in parts of
    twice that many. A null source conflicts with nothing. Repeated rows are packed each, as copies.
    Pieces of equal size go in the order of id, place in the document and source. Null ids are like others, no rows give no
    rows, and only the three columns are looked at.
    """
    kind = type_of(docs, id_col)
    # inline, not the fields of a struct: each text is then cut into words only once
    rows = docs.select(
        docs[id_col].alias("doc"),
        docs[source_col].cast("string").alias("source"),
        F.inline(F.array(word_count_and_group(docs[text_col]))),
    )
    pieces = stored(
        rows.select(
            "doc",
            "source",
            "n",
            F.when(F.col("n") > 0, F.col("group")).alias("group"),
            F.explode(
                F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("long"))
            ).alias("piece"),
        ).select(
            "doc",
            "source",
            "group",
            "piece",
            F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("size"),
        )
    )
    shards = max(1, -(-pieces.count() // block))
    schema = T.StructType(
        [field("shard", T.LongType()), field("doc", kind)]
        + [field(c, T.LongType()) for c in ("piece", "bin", "place", "start", "n_tokens")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, number = None, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(held).to_pydict()
            bins = best_fit(rows["size"], rows["source"], rows["group"], capacity)
            place, filled = Counter(), Counter()
            out = {c: [] for c in ("place", "start", "bin")}
            for b, n in zip(bins, rows["size"]):
                out["bin"].append((shard << 32) + number + b)
                out["place"].append(place[b])
                out["start"].append(filled[b])
                place[b] += 1
                filled[b] += n
            number += max(bins) + 1
            doc = pa.concat_arrays([h.column("doc") for h in held])
            cols = [pa.array(rows["shard"], pa.int64()), doc, pa.array(rows["piece"], pa.int64())]
            cols += [pa.array(out[c], pa.int64()) for c in ("bin", "place", "start")]
            return pa.RecordBatch.from_arrays([*cols, pa.array(rows["size"], pa.int64())], schema.names)

        for batch in batches:
            at = 0
            shards_here = batch.column("shard").to_pylist()
            while at < len(shards_here):
                if held and (shards_here[at] != shard or sum(h.num_rows for h in held) >= 2 * block):
                    yield packed()
                    held = []
                if shards_here[at] != shard:
                    shard, number = shards_here[at], 0
                room = 2 * block - sum(h.num_rows for h in held)
                end = at
                while end < len(shards_here) and end - at < room and shards_here[end] == shard:
                    end += 1
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield packed()

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("long"))
    order = ["shard", F.desc("size"), "doc", "piece", "source", "group"]
    packed = dealt.select("shard", "doc", "piece", "source", "group", "size").repartition("shard")
    return (
        packed.sortWithinPartitions(*order)
        .mapInArrow(run, schema)
        .select(F.col("doc").alias(id_col), "piece", "bin", "place", "start", "n_tokens")
    )
