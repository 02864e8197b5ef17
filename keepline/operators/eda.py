"""Exploratory aggregates: the numbers behind the usual charts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def rate_by(df: DataFrame, cats: list[str], label: str) -> DataFrame:
    """Positive rate per level of several columns, plus the overall rate, in one scan.

    Grouping sets give one group per level; the row with feature '(all)' is the overall rate.
    """
    sets = [[F.col(c)] for c in cats] + [[]]
    gid = F.grouping_id()
    grouped = df.groupingSets(sets, *[F.col(c) for c in cats]).agg(
        gid.alias("gid"), F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate")
    )
    every = 2 ** len(cats) - 1
    feature, level = F.lit("(all)"), F.lit("(all)")
    for i, c in enumerate(cats):
        mine = F.col("gid") == every - 2 ** (len(cats) - 1 - i)
        feature = F.when(mine, F.lit(c)).otherwise(feature)
        level = F.when(mine, F.col(c).cast("string")).otherwise(level)
    return grouped.select(feature.alias("feature"), level.alias("level"), "n", "rate")


def top_level(df: DataFrame, cat: str, label: str) -> DataFrame:
    """Level with the highest rate; ties go to the first name."""
    rates = df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.avg(label).alias("rate"))
    best = rates.agg(F.min(F.struct((-F.col("rate")).alias("r"), F.col(cat).alias("level"))).alias("b"))
    return best.select(F.col("b.level").alias(cat), (-F.col("b.r")).alias("rate"))


def mean_by_class(df: DataFrame, target: str, col: str) -> DataFrame:
    return df.groupBy(target).agg(F.avg(col).alias(f"avg_{col}"))


def overview(df: DataFrame, label: str, n_inputs: int) -> DataFrame:
    """Rows, input columns and overall positive rate."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_inputs).alias("n_inputs"),
        F.avg(label).alias("positive_rate"),
    )


def histogram(
    df: DataFrame, col: str, by: str | None = None, bins: int = 30, density: bool = True
) -> DataFrame:
    """Equal-width histogram from minimum to maximum (per class of ``by``), last bin closed.

    Empty bins are absent. The class ranges are a table of one row per class.
    """
    keys = [by] if by else []
    values = df.select(*keys, F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    ranges = values.groupBy(*keys).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total")
    )
    if by:
        spread = values.join(ranges.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    else:
        row = ranges.first()
        spread = values.withColumns({c: F.lit(row[c]) for c in ("lo", "hi", "total")})
    # A single distinct value is given a range of one around it.
    flat = F.col("hi") == F.col("lo")
    low = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins
    return (
        spread.withColumns({"lo": low, "width": width})
        .withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "bin", "lo", "width", "total")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *keys,
            "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
            "n",
            (
                F.col("n") / (F.col("total") * F.col("width")) if density else F.col("n") / F.col("total")
            ).alias("density" if density else "share"),
        )
    )


def correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of each pair below the diagonal, over the rows that have both values.

    A block of rows gives one matrix product for all pairs, and blocks add up; values are taken from the
    column's mean, so a large mean costs no digits. Null where a column does not vary over the pair's rows;
    NaN counts as missing.
    """
    wide = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    center = np.array([m or 0.0 for m in wide.agg(*[F.avg(c) for c in wide.columns]).first()])
    k = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, k, k))  # of pairs: rows, value of the first, its square, product
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - center
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            sums += [there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x]
        a, b = np.tril_indices(k, -1)
        names = ["i", "j", "n", "sx", "sy", "xx", "yy", "xy"]
        n, s, q, c = sums
        columns = [a, b, n[a, b], s[a, b], s[b, a], q[a, b], q[b, a], c[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names)

    parts = wide.mapInArrow(run, "i long, j long, n double, sx double, sy double, xx double, yy double, xy double")
    t = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")])
    spread = [F.col(q) - F.col(s) * F.col(s) / F.col("n") for q, s in (("xx", "sx"), ("yy", "sy"))]
    varies = (F.col("n") > 0) & (spread[0] > 1e-12 * F.col("xx")) & (spread[1] > 1e-12 * F.col("yy"))
    both = F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")
    names = F.array(*[F.lit(c) for c in cols])
    return t.select(
        F.get(names, F.col("i")).alias("row_name"),
        F.get(names, F.col("j")).alias("col_name"),
        F.when(varies, both / F.sqrt(spread[0]) / F.sqrt(spread[1])).alias("corr"),
    )


def point_cloud(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """The raw points of a scatter chart."""
    return df.select(by, x, y)


def point_density(df: DataFrame, x: str, y: str, by: str, x_width: float, y_width: float) -> DataFrame:
    """The same chart as counts on a grid, which stays small for any number of points."""
    return (
        df.select(
            by,
            F.floor(F.col(x) / x_width).cast("int").alias("x_bin"),
            F.floor(F.col(y) / y_width).cast("int").alias("y_bin"),
        )
        .groupBy(by, "x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
