"""What is in a table: columns, nulls, classes, a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepline.functions.numbers import round_scaled


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, null count, plus the table's shape.

    A single aggregate over the table, turned to long form afterwards.
    """
    fields = df.schema.fields
    nulls = [F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n{i}") for i, f in enumerate(fields)]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *nulls)
    rows = [
        F.struct(
            F.lit(i + 1).alias("ordinal"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"n{i}").alias("nulls"),
        )
        for i, f in enumerate(fields)
    ]
    return wide.select("n_rows", F.lit(len(fields)).alias("n_cols"), F.inline(F.array(*rows)))


def target_values(df: DataFrame, target: str) -> DataFrame:
    """Distinct values of the target column."""
    return df.select(target).distinct()


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per class and share of all labelled rows."""
    labelled = df.where(F.col(target).isNotNull())
    total = labelled.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = labelled.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / total)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Percentage of rows per class, one decimal."""
    share = class_counts(df, target)
    return share.select(target, "n", round_scaled(F.col("share") * 100, 1).alias("percent"))


def sample_rows(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """First ``n`` rows by key (a top-k, not a full sort)."""
    return df.orderBy(key).limit(n)


def limit_users(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Trial mode: only the first ``n`` customers by key."""
    return sample_rows(df, key, n)
