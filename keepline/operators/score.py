"""Scoring: fitted models and coefficient tables to churn probabilities."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepline.operators.boost import BoostedTrees

INTERCEPT = "(intercept)"
MAX_COEFFICIENTS = 100_000


def coefficient_frame(spark: SparkSession, weights: dict[str, float], intercept: float) -> DataFrame:
    """Coefficient table (feature, ordinal, weight); the intercept is a row of its own."""
    rows = [(INTERCEPT, 0, float(intercept))]
    rows += [(f, i + 1, float(w)) for i, (f, w) in enumerate(weights.items())]
    return spark.createDataFrame(rows, "feature string, ordinal int, weight double")


def read_coefficients(table: DataFrame) -> tuple[dict[str, float], float]:
    """A coefficient table as plan constants. It has one row per feature, and that is checked."""
    rows = table.orderBy("ordinal").limit(MAX_COEFFICIENTS + 1).collect()
    if len(rows) > MAX_COEFFICIENTS:
        raise ValueError("not a coefficient table: too many rows")
    weights = {r["feature"]: r["weight"] for r in rows if r["feature"] != INTERCEPT}
    intercept = sum(r["weight"] for r in rows if r["feature"] == INTERCEPT)
    return weights, intercept


def linear_margin(weights: dict[str, float], intercept: float) -> Column:
    """intercept + sum of weight * feature, as one generated expression."""
    terms = [F.lit(w) * F.col(f"`{f}`").cast("double") for f, w in weights.items()]
    return reduce(add, terms, F.lit(float(intercept)))


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def linear_score(df: DataFrame, coefficients: DataFrame, out: str = "churn_prob") -> DataFrame:
    """Probability from a coefficient table: the serving form of the linear model."""
    weights, intercept = read_coefficients(coefficients)
    return df.withColumn(out, sigmoid(linear_margin(weights, intercept)))


def score(model, df: DataFrame, out: str = "churn_prob") -> DataFrame:
    """P(positive) from boosted trees or a fitted Spark ML classifier or pipeline, computed once per row."""
    if isinstance(model, BoostedTrees):
        return model.score(df, out)
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)
