"""Cleaning: numbers from text, fills, target, whitespace, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.functions.numbers import parse_number
from keepline.functions.text import strip
from keepline.operators.ranks import exact_median
from keepline.session import as_table

FEW = 1_000_000  # rows up to which a shuffle of whole rows is cheaper than a look at their hashes first
HASH = "_row_hash"


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text columns to double; blanks and malformed numbers become null."""
    return df.withColumns({c: parse_number(F.col(c)) for c in cols})


def fit_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row table with the exact median of each column."""
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in cols])
    return df.sparkSession.createDataFrame([tuple(exact_median(df, c) for c in cols)], schema)


def impute(df: DataFrame, fills: DataFrame) -> DataFrame:
    """Nulls take the value of the same column in a one-row table."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), fills.select(c).scalar()) for c in fills.columns}
    )


def impute_constant(df: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    """Nulls take a constant."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in cols})


def binary_target(df: DataFrame, target: str, positive: str, out: str) -> DataFrame:
    """1 where the target equals the positive value, else 0; null counts as 0."""
    return df.withColumn(out, F.col(target).eqNullSafe(F.lit(positive)).cast("int"))


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip every string column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: strip(F.col(c)) for c in text}) if text else df


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each set of fully equal rows."""
    return df.dropDuplicates()


def store_distinct(df: DataFrame, name: str, few: int = FEW) -> DataFrame:
    """The distinct rows of df, stored.

    Of many rows only hashes are shuffled: equal rows have equal hashes, so a row whose hash comes
    once has no copy and stays where it is. Rows that share a hash are compared whole.
    """
    if df.count() <= few:
        return as_table(drop_exact_duplicates(df), name)
    rows = as_table(df.withColumn(HASH, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), name)
    again = as_table(rows.groupBy(HASH).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(HASH), "hashes")
    if again.isEmpty():
        return rows.drop(HASH)
    once = rows.join(again, HASH, "left_anti").select(*[f"`{c}`" for c in df.columns])
    shared = rows.join(again, HASH, "left_semi").select(*[f"`{c}`" for c in df.columns])
    return as_table(once.unionByName(drop_exact_duplicates(shared)), name)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one that is largest by ``order``, then by the other columns.

    Nulls are smallest, and rows without a key are one key. The largest row is kept in the
    map-side aggregate, so a key held by most rows costs a row per task.
    """
    rest = [c for c in df.columns if c not in [*keys, *order]]
    row = F.struct(*[df[c] for c in [*order, *rest]])
    kept = df.groupBy(*[df[k] for k in keys]).agg(F.max(row).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows before and after removing exact duplicates, in one pass.

    Copies collapse in the map-side aggregate, so one much-copied row stays cheap.
    """
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"),
            F.count(F.lit(1)).alias("rows_after"),
        )
        .withColumn("removed", F.col("rows_before") - F.col("rows_after"))
    )


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the columns that are present; missing names are ignored."""
    return df.drop(*cols)
