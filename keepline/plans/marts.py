"""Reporting tables over scored customers and the message log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepline.functions.numbers import fixed_text, percent_text, round_scaled
from keepline.functions.text import cut
from keepline.operators.decide import CONFIG, is_flagged, risk_level
from keepline.operators.eda import histogram
from keepline.roles import RISK_LEVELS, RISK_TYPES, DecisionConfig

SORT_COLUMNS = ("churn_prob", "tenure", "MonthlyCharges")


def display_id(number: Column) -> Column:
    """USR_0001 style id from a stable customer number."""
    return F.format_string("USR_%04d", number)


def risk_table(
    scored: DataFrame, key: str, label: str, number: str | None = None, cfg: DecisionConfig = CONFIG
) -> DataFrame:
    """Id, score, flag, label and headline attributes per customer (unordered; see ordered)."""
    prob = F.col("churn_prob")
    shown = [display_id(F.col(number)).alias("user_id")] if number else []
    return scored.select(
        key,
        *shown,
        "churn_prob",
        round_scaled(prob * 100, 1).alias("risk_score_pct"),
        is_flagged(prob, cfg).cast("int").alias("flagged"),
        F.col(label).alias("true_label"),
        "tenure",
        "MonthlyCharges",
        "active_services",
        risk_level(prob, cfg).alias("risk_level"),
    )


def ordered(risk: DataFrame, key: str, by: str = "churn_prob") -> DataFrame:
    """Highest first; equal values in key order."""
    if by not in SORT_COLUMNS:
        raise ValueError(f"sort column must be one of {SORT_COLUMNS}")
    return risk.orderBy(F.desc(by), key)


def filter_risk(
    risk: DataFrame,
    key: str,
    flagged_only: bool = True,
    min_prob: float = CONFIG.flag_threshold,
    sort_by: str = "churn_prob",
) -> DataFrame:
    """The risk table as a user narrows it down."""
    kept = risk.where(F.col("flagged") == 1) if flagged_only else risk
    return ordered(kept.where(F.col("churn_prob") >= min_prob), key, sort_by)


def customer_join(sides: DataFrame, scored: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """Label and side, score and raw attributes of each customer, matched by key.

    Every table is joined on its key, never on row position; customers missing from one are left out.
    """
    return sides.join(scored, key).join(raw, key)


def customer_detail(risk: DataFrame, key: str, value) -> DataFrame:
    """One customer's header line; the key test reaches the Parquet scan."""
    return risk.where(F.col(key) == F.lit(value)).select(
        key,
        F.concat(fixed_text(F.col("risk_score_pct"), 1), F.lit("%")).alias("churn_probability"),
        "risk_level",
        F.concat(fixed_text(F.col("tenure"), 0), F.lit(" months")).alias("tenure_text"),
        F.concat(F.lit("$"), fixed_text(F.col("MonthlyCharges"), 2)).alias("charges_text"),
    )


def score_summary(scored: DataFrame, prob: str = "churn_prob", cfg: DecisionConfig = CONFIG) -> DataFrame:
    """Rows, rows at or above the threshold, their share, mean and largest score."""
    p = F.col(prob)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p >= cfg.flag_threshold).alias("n_flagged"),
        F.avg((p >= cfg.flag_threshold).cast("int")).alias("share_flagged"),
        F.avg(p).alias("mean_prob"),
        F.max(p).alias("max_prob"),
    )


def run_summary(outcomes: DataFrame, scored: DataFrame, prob: str = "churn_prob") -> DataFrame:
    """Counters of one decision run (its duration is the caller's to add).

    A flagged customer without a written message is pending. The mean is that of the scores
    themselves: outcomes hold them rounded.
    """
    sent, idle = F.col("action") == "email_sent", F.col("action") == "no_action"
    mean = scored.agg(F.avg(prob).alias("mean_prob"))
    return outcomes.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~idle).alias("flagged"),
        F.count_if(idle).alias("skipped"),
        F.count_if(sent).alias("messages"),
        F.count_if(F.col("action") == "pending").alias("pending"),
        F.count_if(~idle & F.col("eligible")).alias("eligible"),
    ).withColumn("mean_prob", mean.scalar())


def risk_type_breakdown(outcomes: DataFrame) -> DataFrame:
    """Flagged customers per risk type and their share of all flagged; both types always appear."""
    flagged = F.col("action") != "no_action"
    counts = outcomes.agg(
        F.count_if(flagged).alias("flagged"),
        *[F.count_if(flagged & (F.col("risk_type") == t)).alias(t) for t in RISK_TYPES],
    )
    rows = [
        F.struct(
            F.lit(t).alias("risk_type"),
            F.col(t).alias("n"),
            (F.col(t) / F.greatest("flagged", F.lit(1)) * 100).alias("pct_of_flagged"),
        )
        for t in RISK_TYPES
    ]
    return counts.select(F.inline(F.array(*rows)))


def kpis(risk: DataFrame, log: DataFrame, cfg: DecisionConfig = CONFIG) -> DataFrame:
    """Customers, flagged, high risk, messages, discounts: one row."""
    messages = log.agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("eligible")).alias("discounts")
    )
    return risk.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("flagged") == 1).alias("flagged"),
        F.count_if(F.col("churn_prob") >= cfg.high_risk).alias("high_risk"),
        F.avg("true_label").alias("churn_rate"),
    ).withColumns(
        {
            "messages": messages.select("messages").scalar(),
            "discounts": messages.select("discounts").scalar(),
        }
    )


def risk_level_distribution(risk: DataFrame) -> DataFrame:
    return risk.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def score_histogram(risk: DataFrame, bins: int = 30) -> DataFrame:
    """Distribution of the risk score in percent."""
    return histogram(risk, "risk_score_pct", None, bins, density=False)


def filter_log(log: DataFrame, risk_type: str = "All") -> DataFrame:
    return log if risk_type == "All" else log.where(F.col("risk_type") == risk_type)


def log_view(log: DataFrame, cfg: DecisionConfig = CONFIG) -> DataFrame:
    """Display fields of the message log."""
    pct = F.col("churn_prob") * 100
    return log.select(
        "user_id",
        percent_text(F.col("churn_prob"), 1).alias("churn_risk"),
        "risk_type",
        F.concat(F.col("discount_pct").cast("string"), F.lit("%")).alias("discount"),
        F.when(pct >= cfg.high_risk * 100, F.lit(RISK_LEVELS[0])).otherwise(F.lit(RISK_LEVELS[1])).alias("color_class"),
        cut(F.col("subject"), 50).alias("title_subject"),
        cut(F.col("subject"), 45).alias("preview_subject"),
        cut(F.col("subject"), 40).alias("report_subject"),
        F.replace(F.col("body"), F.lit("\n"), F.lit("<br>")).alias("body_html"),
        "status",
    )


def latest_messages(log: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` messages, newest first (a top-k)."""
    return log.orderBy(F.desc("timestamp"), F.desc("user_id")).limit(n)


def first_flagged(outcomes: DataFrame, n: int = 20) -> DataFrame:
    """Report lines of the first ``n`` flagged customers by id (a top-k); no subject while pending."""
    return (
        outcomes.where(F.col("action") != "no_action")
        .orderBy("user_id")
        .limit(n)
        .select(
            "user_id",
            percent_text(F.col("churn_prob"), 1).alias("churn_prob_text"),
            "risk_type",
            F.concat(F.col("discount_pct").cast("string"), F.lit("%")).alias("discount"),
            cut(F.col("email_subject"), 40).alias("subject"),
        )
    )

