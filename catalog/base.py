"""Tables the queries share. Each is derived by Spark from the given tables, once per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepline.functions.numbers import round_scaled
from keepline.operators.boost import fit_trees, tune_trees
from keepline.operators.clean import binary_target, coerce_numeric, impute_constant
from keepline.operators.decide import flag_at_risk
from keepline.operators.explain import feature_means, linear_contributions
from keepline.operators.features import engineer
from keepline.operators.score import coefficient_frame, linear_score
from keepline.operators.split import stratified_folds
from keepline.operators.train import (
    balanced_weights,
    pos_weight,
    train_logistic,
)
from keepline.plans.decisions import decide, flagged_decisions
from keepline.plans.preprocess import Prepared, preprocess
from keepline.session import as_table
from keepline.sources.panel import panel_from

KEY = "customerID"
LABEL = "Churn_Binary"

# The driver data has random labels, so a trained model flags almost nobody. Decision queries
# use this fixed scorer; the second one stands for "another model" in comparisons.
WEIGHTS = {
    "is_monthly": 1.2, "no_security": 0.9, "is_fiber": 0.8, "is_echeck": 0.5,
    "recency_score": 2.0, "active_services": -0.1, "MonthlyCharges": 0.005, "tenure": -0.01,
}
INTERCEPT = -0.8
OTHER_WEIGHTS = {"is_monthly": 1.0, "tenure": -0.02}
OTHER_INTERCEPT = -0.2
DIGITS = 6  # scores and contributions are rounded once, so that engines agree on every order

TREES = {"trees": 100, "depth": 3, "rate": 0.1}

_memo: dict[tuple, object] = {}


def once(spark: SparkSession, sf: str, name: str, make):
    """Build something once per session and data folder."""
    slot = (spark.sparkContext.applicationId, sf, name)
    if slot not in _memo:
        _memo[slot] = make()
    return _memo[slot]


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The customer panel as a stored table."""
    return once(spark, sf, "snapshots", lambda: as_table(panel_from(spark, sf), "snapshots"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots with numbers parsed, label and engineered columns."""
    parsed = coerce_numeric(snapshots(spark, sf), ["TotalCharges"])
    filled = impute_constant(parsed, ["TotalCharges"], 0.0)
    return engineer(binary_target(filled, "Churn", "Yes", LABEL))


def coefficients(spark: SparkSession) -> DataFrame:
    return coefficient_frame(spark, WEIGHTS, INTERCEPT)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Features with the fixed scorer's probability."""
    out = linear_score(features(spark, sf), coefficients(spark))
    return out.withColumn("churn_prob", round_scaled(F.col("churn_prob"), DIGITS))


def scored_twice(spark: SparkSession, sf: str) -> DataFrame:
    """With a second model's probability beside the first."""
    other = coefficient_frame(spark, OTHER_WEIGHTS, OTHER_INTERCEPT)
    out = linear_score(scored(spark, sf), other, "other_prob")
    return out.withColumn("other_prob", round_scaled(F.col("other_prob"), DIGITS))


def explained(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows with their linear contributions."""
    rows = scored(spark, sf)
    means = once(spark, sf, "means", lambda: feature_means(rows, list(WEIGHTS)))
    out = linear_contributions(rows, coefficients(spark), means)
    rounded = F.transform(
        "contributions",
        lambda c: F.struct(c["feature"].alias("feature"), round_scaled(c["contribution"], DIGITS).alias("contribution")),
    )
    return out.withColumns({"contributions": rounded, "base_value": F.round("base_value", DIGITS)})


def with_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Explained rows under the field names the decision rules read."""
    return flag_at_risk(explained(spark, sf)).withColumn("contract_type", F.col("Contract"))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """An answer per customer with internet service, the rest stay unanswered."""
    s = snapshots(spark, sf).where(F.col("TechSupport") != "No internet service")
    text = F.when(F.col("TechSupport") == "No", F.lit(" Support_issue.\n")).otherwise(F.lit("unsure"))
    return s.select(KEY, text.alias("reply"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """A written message per paperless customer."""
    s = snapshots(spark, sf).where(F.col("PaperlessBilling") == "Yes")
    text = F.concat(
        F.lit("Subject: We value you, customer number "), F.col("customer_no").cast("string"),
        F.lit(", on your "), F.coalesce("Contract", F.lit("current")), F.lit(" plan\n\nHello,\nthank you for "),
        F.col("tenure").cast("string"), F.lit(" months.\n"),
    )
    return s.select(KEY, text.alias("text"))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return flagged_decisions(with_profile(spark, sf), KEY, replies(spark, sf))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return decide(with_profile(spark, sf), KEY, replies(spark, sf), texts(spark, sf))


def prepared(spark: SparkSession, sf: str) -> Prepared:
    """Model-ready features, the raw columns stored, with everything fitted."""
    return once(spark, sf, "prepared", lambda: preprocess(snapshots(spark, sf)))


def training_side(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).features.where(F.col("split") == "train")


def test_side(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).features.where(F.col("split") == "test")


def logistic(spark: SparkSession, sf: str):
    def make():
        rows = balanced_weights(training_side(spark, sf), LABEL)
        return train_logistic(rows, prepared(spark, sf).scaled_names, LABEL)

    return once(spark, sf, "logistic", make)


def boosted(spark: SparkSession, sf: str):
    def make():
        rows = pos_weight(training_side(spark, sf), LABEL)
        return fit_trees(rows, prepared(spark, sf).names, LABEL, **TREES)

    return once(spark, sf, "boosted", make)


def tuned(spark: SparkSession, sf: str):
    def make():
        rows = pos_weight(training_side(spark, sf), LABEL)
        folded = stratified_folds(rows, KEY, LABEL, 5)
        return tune_trees(folded, prepared(spark, sf).names, LABEL, "fold")

    return once(spark, sf, "tuned", make)
