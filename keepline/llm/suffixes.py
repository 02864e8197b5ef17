"""Removal of repeated byte strings by a sparse suffix array.

Every string of 50 bytes names one place in itself, its anchor: of its 35 16-byte grams the one whose
hash is smallest. Only suffixes that start at anchors are sorted, one in about 18, and yet no repeated
string is missed, because equal strings have the same anchor. Suffixes are dealt by their leading
8 bytes between sampled splitters and each bucket is sorted by multikey sort, 8 bytes at a time.
Neighbours that agree on 16 bytes and on the hash of all 50-byte strings of the anchor are repeats at
once; neighbours that agree on the 16 bytes only are the edges of repeats and are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.llm.common import field, stored, type_of

LENGTH = 50
GRAM = 16
CHUNK = 2 << 20
PIECE = 4 << 20
PLACE = (1 << 24) - 1
BUCKET_BYTES = 16 << 20
SAMPLED = 1000
EVENLY = 1000

BASE = 0x9E3779B97F4A7C15 | 1
ODD = np.uint64(0xD6E8FEB86659FD93)
BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    """1, b, b*b, .. modulo 2 ** 64, for b = BASE or its inverse."""
    if name not in _powers or len(_powers[name]) < n:
        b = BASE if name == "up" else pow(BASE, -1, 1 << 64)
        steps = np.full(max(n, 1 << 16), b, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(29))


def anchored(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """The anchors of texts that lie one after the other in `data`.

    Each has its leading 16 bytes as two numbers, the text it is in, the first and last start (lo, hi) of
    the strings of `length` bytes whose anchor it is, and a hash of the bytes these strings cover.
    """
    n = len(data)
    width = length - GRAM + 1
    fields = ("lead", "next", "all", "text", "lo", "hi", "at")
    room = np.repeat(ends, ends - starts) - np.arange(n) if len(starts) else np.zeros(0, dtype=np.int64)
    begins = np.flatnonzero(room >= length)
    if not len(begins):
        return {f: np.zeros(0, dtype=np.uint64 if f in ("lead", "next", "all") else np.int64) for f in fields}
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTES[data] * _power("up", n), out=total[1:])
    down = _power("down", n)
    low = _mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = (low & ~np.uint64(PLACE)) | np.arange(len(low), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = (low[begins] & np.uint64(PLACE)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    lo, hi, at = begins[first], begins[np.r_[first[1:] - 1, len(begins) - 1]], at[first]
    covered = (total[hi + length] - total[lo]) * down[lo]
    shape = ((hi - lo) * 64 + (at - lo)).astype(np.uint64)
    words = data[at[:, None] + np.arange(GRAM)].view(">u8").astype(np.uint64)
    text = np.searchsorted(starts, lo, side="right") - 1
    return {
        "lead": words[:, 0],
        "next": words[:, 1],
        "all": _mix(covered ^ _mix(shape * ODD + ODD)) >> np.uint64(16),
        "text": text,
        "lo": lo,
        "hi": hi,
        "at": at,
    }


def multikey_sort(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order by all keys, and for each key where a new group of equal rows so far begins.

    Rows are sorted by the first key; a later key is looked at only where all before it are equal.
    """
    order = np.argsort(keys[0], kind="stable")
    value = keys[0][order]
    new = np.r_[True, value[1:] != value[:-1]] if len(order) else np.zeros(0, dtype=bool)
    news = [new]
    for key in keys[1:]:
        group = np.cumsum(new)
        tied = np.flatnonzero(~new | ~np.r_[new[1:], True])
        sub = np.lexsort((key[order[tied]], group[tied]))
        order[tied] = order[tied][sub]
        value = key[order]
        new = new.copy()
        new[1:] |= value[1:] != value[:-1]
        news.append(new)
    return order, news


# ---- columns of numbers as compressed bytes

COLUMNS = {"lead": 8, "next": 8, "all": 6, "doc": 8, "lo": 4, "hi": 1, "at": 1}


def _packed(rows: dict[str, np.ndarray], names: tuple[str, ...]) -> bytes:
    planes = [
        np.ascontiguousarray(rows[c].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : COLUMNS[c]].T).tobytes() for c in names
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(blob: bytes, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    n = len(raw) // sum(COLUMNS[c] for c in names)
    out, at = {}, 0
    for c in names:
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, : COLUMNS[c]] = raw[at : at + n * COLUMNS[c]].reshape(COLUMNS[c], n).T
        out[c] = wide.view("<i8" if c == "doc" else "<u8").ravel()  # documents are in the order of signed numbers
        at += n * COLUMNS[c]
    return out


SENT = ("lead", "next", "all", "doc", "lo", "hi", "at")
REPEATED = ("doc", "lo", "hi")


# ---- documents in chunks


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[dict[str, np.ndarray]]:
    """The anchors of all documents (number, text), some megabytes of text at a time, with `doc` and
    with `lo` counted from the start of the document."""
    docs: list[tuple[int, int, bytes]] = []
    size = 0

    def rows() -> dict[str, np.ndarray]:
        lengths = np.array([len(t) for _, _, t in docs], dtype=np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        got = anchored(np.frombuffer(b"".join(t for _, _, t in docs), dtype=np.uint8), starts, ends, length)
        number = np.array([d for d, _, _ in docs], dtype=np.int64)
        offset = np.array([o for _, o, _ in docs], dtype=np.int64) - starts
        text = got.pop("text")
        got["at"] = got["at"] - got["lo"]
        got["hi"] = got["hi"] - got["lo"]
        got["doc"], got["lo"] = number[text], got["lo"] + offset[text]
        return got

    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_py() or b""
            for piece in range(0, max(len(data) - length + 1, 0), PIECE):
                some = data[piece : piece + PIECE + length - 1]
                docs.append((number, piece, some))
                size += len(some)
                if size >= CHUNK:
                    yield rows()
                    docs, size = [], 0
    if docs:
        yield rows()


def _splitters(numbered: DataFrame, buckets: int, length: int) -> np.ndarray:
    """Leading 8 bytes that cut the suffixes into about equal buckets, from about SAMPLED documents.

    The sample only evens out the buckets; the result does not depend on it.
    """
    every = max(1, numbered.count() // SAMPLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, length):
            lead = np.sort(rows["lead"])
            lead = lead[:: max(1, len(lead) // EVENLY)]
            yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64))], ["lead"])

    some = numbered.where(F.pmod(F.xxhash64("number"), F.lit(every)) == 0)
    leads = np.sort(np.array([r[0] for r in some.mapInArrow(run, "lead long").collect()], dtype=np.int64).view(np.uint64))
    if not len(leads):
        return leads
    return np.unique(leads[np.arange(1, buckets) * len(leads) // buckets])


def _suffixes(numbered: DataFrame, splitters: np.ndarray, length: int) -> DataFrame:
    """(bucket, rows): anchored suffixes by bucket, packed. Strings that repeat within a chunk are sent
    once; their later occurrences are known to go and take the further buckets, dealt by document."""
    known = len(splitters) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, length):
            order = np.lexsort((rows["doc"], rows["all"], rows["lead"]))
            rows = {c: v[order] for c, v in rows.items()}
            new = np.r_[True, (rows["all"][1:] != rows["all"][:-1]) | (rows["lead"][1:] != rows["lead"][:-1])][: len(order)]
            new[1:] |= rows["next"][1:] != rows["next"][:-1]
            first = rows["doc"][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else rows["doc"]
            gone = rows["doc"] > first
            bucket = np.searchsorted(splitters, rows["lead"], side="right")
            bucket[gone] = known + rows["doc"][gone] % known
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0][: len(order)])
            names, blobs = [], []
            for some in np.split(order, cuts[1:]) if len(order) else []:
                b = int(bucket[some[0]])
                names.append(b)
                blobs.append(_packed({c: v[some] for c, v in rows.items()}, SENT if b < known else REPEATED))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "rows"])

    return numbered.mapInArrow(run, "bucket int, rows binary")


def _neighbours(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """(doc, mark) of the repeats in one bucket: the mark's anchor is -1 where all strings of the anchor
    repeat, and its place where only a comparison of the bytes can tell."""
    order, (_, grams, alls, _) = multikey_sort([rows[c] for c in ("lead", "next", "all", "doc")])
    doc = rows["doc"][order]
    index = np.arange(len(order))
    first = doc[np.maximum.accumulate(np.where(alls, index, 0))]
    repeated = doc > first
    gram = np.cumsum(grams) - 1
    heads = np.flatnonzero(alls)
    low = np.full(gram[-1] + 1, np.iinfo(np.int64).max)
    high = np.full(gram[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, gram[heads], doc[heads])
    np.maximum.at(high, gram[heads], doc[heads])
    several = np.bincount(gram[heads], minlength=len(low)) > 1
    open_ = ~repeated & (several & (low < high))[gram]
    keep = np.flatnonzero(repeated | open_)
    lo, more, at = (rows[c][order[keep]].astype(np.int64) for c in ("lo", "hi", "at"))
    return {"doc": doc[keep], "mark": _as_marks(lo, more, np.where(repeated[keep], -1, at))}


def _as_marks(lo: np.ndarray, more: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A mark in one number: the first start, how many more, and the anchor's place (-1: all repeat)."""
    return (lo.astype(np.int64) << 20) | (more.astype(np.int64) << 10) | (at.astype(np.int64) + 1)


def _from_marks(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, place of the anchor after the first start or -1)."""
    lo = mark >> 20
    return lo, lo + ((mark >> 10) & 1023), (mark & 1023) - 1


def _sorted_buckets(sent: DataFrame, known: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        last = -1

        def found() -> pa.RecordBatch:
            rows = {c: np.concatenate([h[c] for h in held]) for c in SENT}
            return marks(_neighbours(rows))

        def marks(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows["doc"].astype(np.int64)), pa.array(rows["mark"])], ["doc", "mark"])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and bucket != last:
                    yield found()
                    held = []
                last = bucket
                if bucket < known:
                    held.append(_unpacked(blob.as_py(), SENT))
                    continue
                rows = _unpacked(blob.as_py(), REPEATED)
                yield marks({"doc": rows["doc"], "mark": _as_marks(rows["lo"], rows["hi"], np.full(len(rows["lo"]), -1))})
        if held:
            yield found()

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, mark long")


# ---- bytes to remove


def removed_spans(n: int, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of `length` bytes that start at lo..hi."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64) + length)
    new = np.r_[True, lo[1:] > end[:-1]]
    return list(zip(lo[new].tolist(), end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]].tolist()))


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for start, end in spans:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
NO_MARKS = np.zeros(0, dtype=np.int64)


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    """One row's list of numbers."""
    values = column[row].values
    return NO_MARKS if values is None else values.to_numpy()


def _edges(joined: DataFrame, length: int) -> DataFrame:
    """(gram, number, lo, bytes) around each anchor whose strings are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                yield part(batch.slice(i, 1024))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[bytes, int, int, bytes]] = []
        for row, number in enumerate(batch.column(0).to_pylist()):
            lo, hi, at = _from_marks(_numbers(batch.column(2), row))
            wanted = np.flatnonzero(at >= 0)
            if len(wanted):
                data = batch.column(1)[row].as_py()
                for x, y, a in zip(lo[wanted].tolist(), hi[wanted].tolist(), at[wanted].tolist()):
                    out.append((data[x + a : x + a + GRAM], number, x, data[x : y + length]))
        cols = list(zip(*out)) if out else [(), (), (), ()]
        types = (pa.binary(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["gram", "number", "lo", "bytes"])

    return joined.select("number", "text", "marks").mapInArrow(run, "gram binary, number long, lo int, bytes binary")


def _compared(edges: DataFrame, length: int) -> DataFrame:
    """(number, mark): starts of strings, among those around open anchors, that a smaller document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, {}
        for batch in batches:
            numbers, starts, ends = [], [], []
            for gram, number, lo, data in zip(*(c.to_pylist() for c in batch.columns)):
                if gram != last:
                    last, seen = gram, {}
                at = -2
                for i in range(len(data) - length + 1):
                    if seen.setdefault(data[i : i + length], number) < number:
                        if at == i - 1:
                            ends[-1] = lo + i
                        else:
                            numbers.append(number)
                            starts.append(lo + i)
                            ends.append(lo + i)
                        at = i
            lo, hi = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)
            mark = _as_marks(lo, hi - lo, np.full(len(lo), -1))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(mark)], ["number", "mark"])

    dealt = edges.repartition("gram").sortWithinPartitions("gram", "number", "lo")
    return dealt.mapInArrow(run, "number long, mark long")


def _finished(joined: DataFrame, compared: DataFrame, length: int) -> DataFrame:
    """(number, spans, n_bytes, kept_sha256) of each document from all its marks."""
    lists = compared.groupBy("number").agg(F.collect_list("mark").alias("more"))
    rows = joined.join(lists, "number", "left").select("number", "text", "marks", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, sizes, digests = [], [], []
            for row, text in enumerate(batch.column(1)):
                data = text.as_py() or b""
                lo, hi, at = _from_marks(np.concatenate([_numbers(batch.column(c), row) for c in (2, 3)]))
                got = removed_spans(len(data), lo[at < 0], hi[at < 0], length)
                spans.append([{"start": s, "end": e} for s, e in got])
                sizes.append(len(data))
                digests.append(hashlib.sha256(without(data, got)).hexdigest())
            columns = [batch.column(0), pa.array(spans, SPAN), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["number", "spans", "n_bytes", "kept_sha256"])

    return rows.mapInArrow(run, "number long, spans array<struct<start:int,end:int>>, n_bytes long, kept_sha256 string")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Documents as (number, text) in the order of their ids.

    Whole-number ids that name one text each are their own numbers. Otherwise numbers are given by id
    and then by the hash of the text, null ids last; the second result maps them back.
    """
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].cast("binary").alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    if isinstance(type_of(docs, id_col), (T.LongType, T.IntegerType, T.ShortType)):
        odd = rows.groupBy("doc").agg((F.min("version") < F.max("version")).alias("several"))
        if odd.where("several or doc is null").isEmpty():
            return rows.select(F.col("doc").cast("long").alias("number"), "text"), None
    order = [F.col("doc").asc_nulls_last(), F.col("version")]
    names = rows.select("doc", "version").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    names = stored(names.withColumn("number", F.monotonically_increasing_id()))
    same = rows["doc"].eqNullSafe(names["doc"]) & (rows["version"] == names["version"])
    return rows.join(names, same).select("number", "text"), names.select("number", "doc")


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(id, n_bytes, spans, kept_sha256), one row per row of docs.

    `spans` are the maximal runs (start, end) of UTF-8 bytes covered by a string of `length` bytes that
    also starts in a document with a smaller id; kept_sha256 is the digest of the other bytes. Strings
    don't cross documents and are looked for in the input. A null text is empty. Repeated rows are one
    document and get the same spans. Rows that share an id but not the text, or have no id, are
    documents of their own, ordered by id, nulls last, then by the hash of the text. Ids may be negative.
    Only the two columns are looked at; no rows give no rows; texts of any length are read whole, in
    pieces. length is at least 2 * GRAM and at most 200.
    """
    if not 2 * GRAM <= length <= 200:
        raise ValueError("length is to be between 32 and 200")
    numbered, names = _numbered(docs, id_col, text_col)
    size = numbered.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    splitters = _splitters(numbered, max(1, -(-size // bucket_bytes)), length)
    marks = _sorted_buckets(_suffixes(numbered, splitters, length), len(splitters) + 1)
    lists = marks.groupBy("doc").agg(F.collect_list("mark").alias("marks"))
    # Both uses of `joined` are in one plan, so its texts are shuffled once and read twice.
    joined = numbered.join(lists, numbered["number"] == lists["doc"], "left").select("number", "text", "marks")
    done = _finished(joined, _compared(_edges(joined, length), length), length)
    if names is None:
        kind = type_of(docs, id_col)
        return done.select(F.col("number").cast(kind).alias(id_col), "n_bytes", "spans", "kept_sha256")
    return done.join(names, "number").select(F.col("doc").alias(id_col), "n_bytes", "spans", "kept_sha256")
