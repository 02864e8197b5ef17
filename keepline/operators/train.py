"""Class weights, the models of Spark ML, and what a fitted model says about itself."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepline.functions.numbers import round_scaled
from keepline.operators import boost
from keepline.operators.boost import BoostedTrees
from keepline.operators.score import INTERCEPT
from keepline.operators.split import classes_of, per_class
from keepline.session import shared_dir


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (classes * rows of the class), so every class weighs the same in total."""
    classes = classes_of(df, label)
    n = sum(c for _, c in classes)
    return df.withColumn(out, per_class(label, {v: n / (len(classes) * c) for v, c in classes}))


def pos_weight_ratio(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives, positives and their ratio to two decimals."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")
    )
    ratio = F.when(F.col("pos") > 0, round_scaled(F.col("neg") / F.col("pos"), 2))
    return counts.withColumn("ratio", ratio)


def pos_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Positives weigh neg/pos, negatives 1."""
    ratio = pos_weight_ratio(df, label).first()["ratio"]
    if ratio is None:
        raise ValueError(f"{label} has no positive rows")
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(ratio)).otherwise(F.lit(1.0)))


def assembler(features: list[str]) -> VectorAssembler:
    """Feature columns to one vector; the order is the feature-name list of the model."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def feature_names(model: PipelineModel | BoostedTrees) -> list[str]:
    """The feature list a fitted model was trained on."""
    return list(model.features if isinstance(model, BoostedTrees) else model.stages[0].getInputCols())


def train_logistic(
    df: DataFrame, features: list[str], label: str, c: float = 1.0, weight: str = "weight"
) -> PipelineModel:
    """L2-regularised logistic regression on weighted rows.

    ``c`` multiplies the data term, so the penalty per unit of weight is 1 / (c * total weight).
    """
    total = df.agg(F.sum(weight)).first()[0]
    lr = LogisticRegression(
        labelCol=label,
        weightCol=weight,
        regParam=1.0 / (c * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
    )
    return Pipeline(stages=[assembler(features), lr]).fit(df)


def boosted_trees(label: str, weight: str = "weight", seed: int = 42, **params) -> GBTClassifier:
    """Boosted-tree classifier with the library's own parameter names."""
    return GBTClassifier(labelCol=label, weightCol=weight, seed=seed, **params)


def checkpoint_between_trees(df: DataFrame) -> None:
    """Boosting checkpoints its running errors every few trees, given a shared folder."""
    context, folder = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
    if folder and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)


def train_boosted(
    df: DataFrame, features: list[str], label: str, weight: str = "weight", seed: int = 42, **params
) -> PipelineModel:
    """First-order boosted trees of Spark ML; `boost.fit_trees` are the second-order ones."""
    checkpoint_between_trees(df)
    gbt = boosted_trees(label, weight, seed, **params)
    return Pipeline(stages=[assembler(features), gbt]).fit(df)


def coefficient_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, ordinal, weight) of a fitted linear model, intercept included."""
    linear = model.stages[-1]
    rows = [(INTERCEPT, 0, float(linear.intercept))]
    names = feature_names(model)
    rows += [(n, i + 1, float(w)) for i, (n, w) in enumerate(zip(names, linear.coefficients))]
    return df.sparkSession.createDataFrame(rows, "feature string, ordinal int, weight double")


def top_coefficients(table: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` largest weights by size, listed in ascending order of weight."""
    return (
        table.where(F.col("feature") != INTERCEPT)
        .orderBy(F.abs("weight").desc(), "ordinal")
        .limit(n)
        .orderBy("weight", "ordinal")
    )


def importance_table(model: PipelineModel | BoostedTrees, df: DataFrame) -> DataFrame:
    """Gain importance per feature, summing to one."""
    if isinstance(model, BoostedTrees):
        return boost.importance_table(model, df.sparkSession)
    scores = model.stages[-1].featureImportances.toArray()
    rows = [(n, i + 1, float(s)) for i, (n, s) in enumerate(zip(feature_names(model), scores))]
    return df.sparkSession.createDataFrame(rows, "feature string, ordinal int, importance double")


def top_importances(table: DataFrame, n: int = 15) -> DataFrame:
    return table.orderBy(F.desc("importance"), "ordinal").limit(n)
