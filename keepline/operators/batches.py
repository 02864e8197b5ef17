"""Profiles of tables that grow by batches: each batch is read once, summaries are stored and merged.

Counts, nulls, extremes and sums merge exactly; distinct values and quantiles are sketches
(HyperLogLog and KLL), whose errors merging does not add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.operators.eda import rate_by
from keepline.sources.log import replace_partition

# Relative standard error of the distinct count: about 1.04 / sqrt(2^12) = 1.6 %.
HLL_BITS = 12
# Rank error of a quantile: about 0.8 % at 400.
KLL_SIZE = 400
QUANTILES = (0.25, 0.5, 0.75)


def _summary(field: T.StructField) -> Column:
    """One column's summary as a struct; numbers have moments and a quantile sketch, NaN counting as null."""
    c = F.col(f"`{field.name}`")
    number = isinstance(field.dataType, T.NumericType)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    # decimals and booleans are sketched by their text
    plain = isinstance(field.dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType))
    value = c.cast("double") if number else F.lit(None).cast("double")
    nothing = F.lit(None).cast("binary")
    return F.struct(
        F.lit(field.name).alias("column_name"),
        F.lit(field.dataType.simpleString()).alias("dtype"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(c.isNull()).alias("nulls"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.sum(value).alias("total"),
        F.hll_sketch_agg(c if plain else c.cast("string"), F.lit(HLL_BITS)).alias("values"),
        (F.kll_sketch_agg_double(value, F.lit(KLL_SIZE)) if number else nothing).alias("ranks"),
    )


def summarise(df: DataFrame) -> DataFrame:
    """One row per column, for `merge_profiles`: one scan and one aggregate for all columns."""
    each = [_summary(f).alias(f"s{i}") for i, f in enumerate(df.schema.fields)]
    return df.agg(*each).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(each))])))


def merge_profiles(summaries: DataFrame) -> DataFrame:
    """One row per column over all batches: counts, nulls, extremes, mean, distinct values, quartiles.

    ``distinct`` and the quartiles are estimates, everything else is exact.
    """
    some = F.col("n_rows") > F.col("nulls")
    merged = summaries.groupBy("column_name", "dtype").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("nulls").alias("nulls"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.sum("total").alias("total"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct"),
        F.kll_merge_agg_double(F.when(some, F.col("ranks"))).alias("ranks"),
    )
    numbers = F.col("total").isNotNull()
    quartiles = [
        F.when(numbers, F.kll_sketch_get_quantile_double("ranks", F.lit(q))).alias(f"q{round(q * 100)}") for q in QUANTILES
    ]
    mean = F.col("total") / (F.col("n_rows") - F.col("nulls"))
    return merged.select("column_name", "dtype", "n_rows", "nulls", "distinct", "least", "greatest", F.when(numbers, mean).alias("mean"), *quartiles)


def level_counts(df: DataFrame, cats: list[str], label: str) -> DataFrame:
    """Rows and positives per level of several columns and overall: exact, and added up by `merge_rates`."""
    rates = rate_by(df.select(*cats, F.col(label).cast("double").alias(label)), cats, label)
    return rates.select("feature", "level", "n", F.round(F.col("rate") * F.col("n")).cast("long").alias("positives"))


def merge_rates(counts: DataFrame) -> DataFrame:
    """Positive rate per level over all batches, as `rate_by` gives for the whole table."""
    both = counts.groupBy("feature", "level").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    return both.select("feature", "level", "n", (F.col("positives") / F.col("n")).alias("rate"))


def add_batch(df: DataFrame, path: str, batch: str, cats: list[str] | None = None, label: str | None = None) -> None:
    """Store the summaries of one batch. Adding a batch again replaces it; other batches are not read."""
    replace_partition(summarise(df), f"{path}/columns", batch, "parquet")
    if cats:
        replace_partition(level_counts(df, cats, label), f"{path}/levels", batch, "parquet")


def profile_of(spark: SparkSession, path: str) -> DataFrame:
    """The merged profile of all batches added so far."""
    return merge_profiles(spark.read.parquet(f"{path}/columns"))


def rates_of(spark: SparkSession, path: str) -> DataFrame:
    """The merged rates of all batches added so far."""
    return merge_rates(spark.read.parquet(f"{path}/levels"))
