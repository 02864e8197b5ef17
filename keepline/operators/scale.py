"""Standardisation with the population standard deviation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepline.session import pin


def _moments(n_columns: int):
    """Made here so that it travels to executors by value; they need not have this package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(ordinal, n, mean, m2) of each column's values in a task; equal values have m2 exactly 0."""
        n, mean, m2 = np.zeros(n_columns, dtype=np.int64), np.zeros(n_columns), np.zeros(n_columns)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                x = (column.drop_null() if column.null_count else column).to_numpy()
                if not len(x):
                    continue
                apart = x - x[0]
                off = apart.mean()
                apart -= off
                step, whole = x[0] + off - (mean[i] if n[i] else 0.0), n[i] + len(x)
                mean[i] += step * (len(x) / whole)
                m2[i] += apart @ apart + (step * step * (n[i] * (len(x) / whole)) if n[i] else 0.0)
                n[i] = whole
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n_columns, dtype=np.int32)), pa.array(n), pa.array(mean), pa.array(m2)],
            ["ordinal", "n", "mean", "m2"],
        )

    return run


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """Parameter table (feature, mean, scale), one pass; a constant column gets scale 1.

    Tasks hand on count, mean and sum of squares about it per column, which are then put together.
    """
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = values.mapInArrow(_moments(len(cols)), "ordinal int, n long, mean double, m2 double")
    found = parts.groupBy("ordinal").agg(
        F.sum("n").alias("rows"),
        F.min(F.when(F.col("n") > 0, F.col("mean"))).alias("near"),
        F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean", "m2"))).alias("parts"),
    )
    total = lambda term: F.aggregate("parts", F.lit(0.0), lambda a, p: a + term(p))
    spread = lambda p: p["m2"] + p["n"] * (p["mean"] - F.col("middle")) * (p["mean"] - F.col("middle"))
    some = F.col("rows") > 0
    scaled = (
        found.withColumn("middle", F.when(some, F.col("near") + total(lambda p: p["n"] * (p["mean"] - F.col("near"))) / F.col("rows")))
        .withColumn("scale", F.when(some, F.sqrt(total(spread) / F.col("rows"))))
    )
    names = F.array(*[F.lit(c) for c in cols])
    return pin(
        scaled.orderBy("ordinal").select(
            F.get(names, F.col("ordinal")).alias("feature"),
            F.col("middle").alias("mean"),
            F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale")).alias("scale"),
        ),
        len(cols),
    )


def apply_scaler(df: DataFrame, params: DataFrame, suffix: str = "") -> DataFrame:
    """(x - mean) / scale per feature; ``suffix`` keeps the raw column beside the scaled one."""
    return df.withColumns(
        {
            f"{r['feature']}{suffix}": (F.col(f"`{r['feature']}`").cast("double") - F.lit(r["mean"]))
            / F.lit(r["scale"])
            for r in params.collect()
        }
    )
