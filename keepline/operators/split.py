"""Exact, reproducible stratified splits and folds.

Rows of a class are put in hash order of their key and cut at exact ranks. The cut points are
found with narrow aggregates: row counts per hash range say which range holds the wanted rank,
and only that range is looked at closely. What comes out is a handful of (hash, key) constants,
so assigning the sides is a plain column expression: no wide row is ever shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CLASSES = 1000
MAX_RANGES = 4_000_000
PER_RANGE = 500_000  # rows of a class that one task looks at closely
HASH_DIGITS = 8


def key_hash(key: Column, seed: int) -> Column:
    """Eight hex digits from the key; the same in any engine that has md5."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, HASH_DIGITS)


def classes_of(df: DataFrame, label: str) -> list[tuple]:
    """(class, rows), sorted; more than a thousand classes is an error."""
    found = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return sorted(((r[0], r[1]) for r in found), key=lambda p: (p[0] is not None, p[0]))


def per_class(label: str, values: dict) -> Column:
    """The number that belongs to the row's class."""
    out = F.lit(None)
    for value, number in values.items():
        out = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(number)).otherwise(out)
    return out


def rank_keys(
    df: DataFrame, key: str, label: str, seed: int, ranks: dict, digits: int | None = None
) -> dict[tuple, tuple[str, object]]:
    """The (hash, key) found at each wanted 1-based rank of each class.

    ``16**digits`` hash ranges per class; a range is all one task ever sorts, and unless told
    otherwise their number follows the highest rank. Rows of equal key count together and stay
    together, so quotas are exact for unique keys (see ``latest_per_key``). A null key is an error.
    """
    if digits is None:
        highest = max((r for places in ranks.values() for r in places), default=1)
        digits = min(max(1, math.ceil(math.log(max(highest / PER_RANGE, 1), 16))) + 1, HASH_DIGITS)
    if 16**digits * max(len(ranks), 1) > MAX_RANGES:
        raise ValueError(f"{digits} digits for {len(ranks)} classes make more than {MAX_RANGES} ranges")
    rows = df.select(F.col(label).alias("y"), F.col(key).alias("k")).withColumn(
        "h", key_hash(F.col("k"), seed)
    )
    in_range = F.substring("h", 1, digits)
    counts = rows.groupBy("y", in_range.alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()
    if any(c["r"] is None for c in counts):
        raise ValueError(f"{key} has null values; every row needs a key")
    sizes: dict = {}
    for c in sorted(counts, key=lambda c: c["r"]):
        sizes.setdefault(c["y"], []).append((c["r"], c["n"]))
    wanted: dict[tuple, list[tuple[int, int]]] = {}  # (class, range) -> [(rank, rank in range)]
    for y, positions in ranks.items():
        ends = list(accumulate(n for _, n in sizes.get(y, [])))
        for rank in positions:
            i = bisect_left(ends, rank)
            before = ends[i - 1] if i else 0
            wanted.setdefault((y, sizes[y][i][0]), []).append((rank, rank - before))
    if not wanted:
        return {}
    near = F.lit(False)
    for y, r in wanted:
        near = near | (F.col("y").eqNullSafe(F.lit(y)) & (F.col("r") == r))
    up_to = Window.partitionBy("y", "r").orderBy("h", "k")
    placed = (
        rows.withColumn("r", in_range)
        .where(near)
        .groupBy("y", "r", "h", "k")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("end", F.sum("n").over(up_to.rowsBetween(Window.unboundedPreceding, 0)))
    )
    hit = F.lit(False)
    for (y, r), places in wanted.items():
        for _, place in places:
            covers = (F.col("end") >= place) & (F.col("end") - F.col("n") < place)
            hit = hit | (F.col("y").eqNullSafe(F.lit(y)) & (F.col("r") == r) & covers)
    out = {}
    for row in placed.where(hit).collect():
        for rank, place in wanted[(row["y"], row["r"])]:
            if row["end"] - row["n"] < place <= row["end"]:
                out[(row["y"], rank)] = (row["h"], row["k"])
    return out


def _up_to(key: str, point: tuple[str, object]) -> Column:
    """Whether a row, its hash in ``_h``, comes at or before the point in hash order."""
    h, k = point
    return (F.col("_h") < h) | ((F.col("_h") == h) & (F.col(key) <= F.lit(k)))


def test_quotas(classes: list[tuple], test_size: float) -> dict:
    """Test rows per class: the total is ceil(test_size * n), shares by largest remainder."""
    n = sum(c for _, c in classes)
    n_train = n - math.ceil(test_size * n)
    exact = [(label, c, c * n_train / n if n else 0.0) for label, c in classes]
    train = {label: math.floor(x) for label, _, x in exact}
    by_remainder = sorted(exact, key=lambda e: -(e[2] - math.floor(e[2])))
    for label, _, _ in by_remainder[: n_train - sum(train.values())]:
        train[label] += 1
    return {label: c - train[label] for label, c in classes}


def stratified_split(
    df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42, digits: int | None = None
) -> DataFrame:
    """Adds ``split`` = 'train' | 'test' with exact class quotas.

    Membership depends on seed and key only, not on partitioning or row order.
    """
    quotas = test_quotas(classes_of(df, label), test_size)
    points = rank_keys(df, key, label, seed, {y: [q] for y, q in quotas.items() if q}, digits)
    is_test = F.lit(False)
    for (y, _), point in points.items():
        is_test = is_test | (F.col(label).eqNullSafe(F.lit(y)) & _up_to(key, point))
    side = F.when(is_test, F.lit("test")).otherwise(F.lit("train"))
    return df.withColumn("_h", key_hash(F.col(key), seed)).withColumn("split", side).drop("_h")


def fold_sizes(classes: list[tuple], k: int) -> dict[object, list[int]]:
    """Rows per class and fold: classes are dealt in turn, each going on where the last ended."""
    out, seen = {}, 0
    for y, n in classes:
        out[y] = [(n - (f - seen) % k + k - 1) // k if (f - seen) % k < n else 0 for f in range(k)]
        seen += n
    return out


def stratified_folds(
    df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, out: str = "fold", digits: int | None = None
) -> DataFrame:
    """Adds fold numbers 0..k-1; sizes differ by at most one, per class and overall."""
    ends = {y: list(accumulate(sizes)) for y, sizes in fold_sizes(classes_of(df, label), k).items()}
    cuts = {y: sorted({e for e in es[:-1] if e}) for y, es in ends.items()}
    points = rank_keys(df, key, label, seed, cuts, digits)
    fold = F.lit(None).cast("int")
    for y, es in ends.items():
        mine = F.lit(k - 1)
        for f in reversed(range(k - 1)):
            if es[f]:
                mine = F.when(_up_to(key, points[(y, es[f])]), F.lit(f)).otherwise(mine)
        fold = F.when(F.col(label).eqNullSafe(F.lit(y)), mine).otherwise(fold)
    return df.withColumn("_h", key_hash(F.col(key), seed)).withColumn(out, fold).drop("_h")


def split_summary(df: DataFrame, label: str, n_features: int) -> DataFrame:
    """Rows, feature count and positive rate per side."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_features).alias("n_features"),
        F.avg(label).alias("positive_rate"),
    )
