"""Exact running totals and order statistics without a single-task sort.

The rows are grouped by value once and the totals stored; everything else reads that table. Its
values are cut into ordered buckets at approximate quantiles. Totals per bucket are a small table
whose running sum gives each bucket's offset, so buckets can be worked on independently. Any cut
points give exact results; good ones only balance the work.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepline.session import as_table

_BUCKET = "_bucket"
_ROWS = "_rows"
PER_BUCKET = 100_000  # distinct values that one task sorts


def _grouped(df: DataFrame, col: str, sums: dict[str, Column], skip_unusable: bool, by: list[str] | None = None) -> DataFrame:
    """One stored row per distinct value (of each ``by``). Rows without a usable value are skipped or an error."""
    added = [F.sum(e).alias(name) for name, e in sums.items()]
    table = as_table(df.groupBy(*(by or []), col).agg(*added, F.count(F.lit(1)).alias(_ROWS)), "totals")
    unusable = F.col(col).isNull() | F.isnan(col)
    if not skip_unusable:
        lost = table.where(unusable).agg(F.sum(_ROWS)).first()[0]
        if lost:
            raise ValueError(f"{lost} rows have no usable {col}")
    return table.where(~unusable)


def _in_buckets(grouped: DataFrame, col: str, buckets: int | None) -> DataFrame:
    """The grouped rows with their ordered bucket number.

    The number of buckets follows the number of distinct values. The cut points become constants of
    the plan, so every pass, and every retry, sees the same ones.
    """
    buckets = buckets or max(1, -(-grouped.count() // PER_BUCKET))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(grouped.approxQuantile(col, probs, 1.0 / (2 * buckets)))) if probs else []
    if not cuts:
        return grouped.withColumn(_BUCKET, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol=_BUCKET).transform(grouped)


def value_totals(
    df: DataFrame, col: str, sums: dict[str, Column], buckets: int | None = None, by: str | None = None
) -> DataFrame:
    """One row per distinct value with its sums, and the running sums ``cum_*`` up to it.

    The rows are read once. A value held by most rows costs one row. Null or NaN is an error. With
    ``by``, totals run within each of its few values, all in the same passes.
    """
    keys = [by] if by else []
    rows = _in_buckets(_grouped(df, col, sums, False, keys), col, buckets)
    totals = rows.groupBy(*keys, _BUCKET).agg(*[F.sum(name).alias(name) for name in sums])
    before, offsets = {}, []
    for r in totals.orderBy(*keys, _BUCKET).collect():
        of = tuple(r[k] for k in keys)
        so_far = before.get(of, [0] * len(sums))
        offsets.append((*of, r[_BUCKET], *so_far))
        before[of] = [x + r[name] for x, name in zip(so_far, sums)]
    renamed = totals.toDF(*[f"_of_{k}" for k in keys], "_b", *[f"_before_{n}" for n in sums])
    table = df.sparkSession.createDataFrame(offsets, renamed.schema)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(_BUCKET) == F.col("_b")
    for k in keys:
        same &= F.col(k) == F.col(f"_of_{k}")
    return (
        rows.withColumns({f"cum_{n}": F.sum(n).over(inside) for n in sums})
        .join(table, same)
        .select(*keys, col, *sums, *[(F.col(f"cum_{n}") + F.col(f"_before_{n}")).alias(f"cum_{n}") for n in sums])
    )


def exact_median(df: DataFrame, col: str, buckets: int | None = None) -> float | None:
    """The exact median: mean of the two middle values; nulls and NaN don't count, None without values.

    Counts per bucket tell where the middle ranks are; only that bucket's distinct values are
    sorted.
    """
    values = df.select(F.col(col).cast("double").alias("v"))
    rows = _in_buckets(_grouped(values, "v", {}, skip_unusable=True), "v", buckets)
    sizes = rows.groupBy(_BUCKET).agg(F.sum(_ROWS).alias("n")).orderBy(_BUCKET).collect()
    ends = list(accumulate(r["n"] for r in sizes))
    if not ends:
        return None
    places = []  # (bucket, rank within it) of the two middle rows
    for rank in ((ends[-1] + 1) // 2, ends[-1] // 2 + 1):
        i = bisect_left(ends, rank)
        places.append((sizes[i][_BUCKET], rank - (ends[i - 1] if i else 0)))
    up_to = Window.partitionBy(_BUCKET).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.where(F.col(_BUCKET).isin([b for b, _ in places])).withColumn("end", F.sum(_ROWS).over(up_to))

    def covers(bucket: float, rank: int) -> Column:
        return (F.col(_BUCKET) == bucket) & (F.col("end") >= rank) & (F.col("end") - F.col(_ROWS) < rank)

    found = ranked.agg(*[F.max(F.when(covers(b, r), F.col("v"))) for b, r in places]).first()
    return (found[0] + found[1]) / 2
