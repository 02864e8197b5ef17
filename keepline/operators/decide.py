"""Retention rules: flag, risk type, discount. Ordered column expressions, no row functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepline.functions.numbers import fixed_text, percent_text, round_exact
from keepline.functions.text import lookup, render, strip
from keepline.roles import (
    DISCOUNT_REASONS,
    DISENGAGE_SIGNALS,
    REPLY_METHOD,
    RISK_LEVELS,
    ROUTING,
    RULE_METHOD,
    SUPPORT_SIGNALS,
    DecisionConfig,
)

CONFIG = DecisionConfig()


def is_flagged(prob: Column, cfg: DecisionConfig = CONFIG) -> Column:
    """At or above the threshold; an unknown score is not flagged."""
    return F.coalesce(prob >= cfg.flag_threshold, F.lit(False))


def flag_at_risk(df: DataFrame, prob: str = "churn_prob", cfg: DecisionConfig = CONFIG) -> DataFrame:
    return df.withColumn("flagged", is_flagged(F.col(prob), cfg).cast("int"))


def risk_level(prob: Column, cfg: DecisionConfig = CONFIG) -> Column:
    high, medium, low = RISK_LEVELS
    return (
        F.when(prob >= cfg.high_risk, F.lit(high))
        .when(prob >= cfg.flag_threshold, F.lit(medium))
        .otherwise(F.lit(low))
    )


def contract_from_one_hot(two_year: Column, one_year: Column) -> Column:
    """Contract name from raw 0/1 columns; neither set means month-to-month."""
    return (
        F.when(two_year == 1, F.lit("Two year"))
        .when(one_year == 1, F.lit("One year"))
        .otherwise(F.lit("Month-to-month"))
    )


def profile_for_decision(df: DataFrame, contract: Column, *keep: str) -> DataFrame:
    """The eight fields the rules read, typed, with missing values as zero."""

    def number(c: str, kind: str) -> Column:
        return F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c)

    return df.select(
        *keep,
        number("tenure", "double"),
        number("MonthlyCharges", "double"),
        number("TotalCharges", "double"),
        contract.alias("contract_type"),
        number("active_services", "double"),
        number("is_monthly", "int"),
        number("is_fiber", "int"),
        number("SeniorCitizen", "int"),
    )


def classify_rule(top_reasons: Column) -> Column:
    """Risk type by counting signal features among the top reasons; null when unclear.

    Counting keeps repeats, which a set intersection would lose.
    """

    def hits(signals: tuple[str, ...]) -> Column:
        return F.size(F.filter(top_reasons, lambda r: r["feature"].isin(*signals)))

    support, away = hits(SUPPORT_SIGNALS), hits(DISENGAGE_SIGNALS)
    return F.when((support >= 2) & (support > away), F.lit("support_issue")).when(
        (away >= 2) & (away > support), F.lit("disengagement")
    )


def classify_reply(reply: Column) -> Column:
    """Risk type from a free-text answer; anything without 'support', or no answer, is disengagement."""
    says_support = F.contains(F.lower(strip(reply)), F.lit("support"))
    return F.when(says_support, F.lit("support_issue")).otherwise(F.lit("disengagement"))


def one_reply_per_key(replies: DataFrame, key: str, text: str) -> DataFrame:
    """Answers may be written twice when a task is retried; keep one per customer."""
    return replies.groupBy(key).agg(F.max(text).alias(text))


def detect_behavior(
    df: DataFrame, key: str, replies: DataFrame | None = None, reply: str = "reply"
) -> DataFrame:
    """Adds risk_type, method, confidence, reasons and routing.

    Rules decide first; ``replies`` (key, reply) settles the unclear ones.
    """
    ruled = df.withColumn("_rule", classify_rule(F.col("top_reasons")))
    if replies is None:
        ruled = ruled.withColumn("_reply", F.lit(None).cast("string"))
    else:
        answers = one_reply_per_key(replies, key, reply).withColumnRenamed(reply, "_reply")
        ruled = ruled.join(answers, key, "left")
    by_rule = F.col("_rule").isNotNull()
    typed = ruled.withColumn("risk_type", F.coalesce("_rule", classify_reply(F.col("_reply"))))
    return typed.withColumns(
        {
            "method": F.when(by_rule, F.lit(RULE_METHOD)).otherwise(F.lit(REPLY_METHOD)),
            "confidence": F.when(by_rule, F.lit("high")).otherwise(F.lit("medium")),
            "reasons": F.col("top_reasons")["reason"],
            "routing": lookup(F.col("risk_type"), ROUTING),
        }
    ).drop("_rule", "_reply")


def ltv(tenure: Column, monthly: Column) -> Column:
    """Lifetime value to the cent."""
    return round_exact(tenure * monthly, 2)


def assess_discount(
    tenure: Column,
    monthly: Column,
    contract: Column,
    prob: Column,
    cfg: DecisionConfig = CONFIG,
    value: Column | None = None,
) -> Column:
    """Discount decision as one struct; the first rule that applies wins.

    ``value`` is the lifetime value if a column already holds it.
    """
    tenure, monthly = tenure.cast("double"), monthly.cast("double")
    value = ltv(tenure, monthly) if value is None else value
    words = {
        "tenure": fixed_text(tenure, 0),
        "min_tenure": F.lit(str(cfg.min_tenure)),
        "monthly": fixed_text(monthly, 0),
        "min_monthly": F.lit(f"{cfg.min_monthly:.0f}"),
        "risk": percent_text(prob),
        "ltv": fixed_text(value, 0),
    }
    high, flagged = prob >= cfg.high_risk, prob >= cfg.flag_threshold
    rich, fair = value >= cfg.high_ltv, value >= cfg.min_ltv
    # condition, reason, strategy, percent
    rules = [
        (tenure < cfg.min_tenure, "too_new", "free_trial_extension", 0),
        (monthly < cfg.min_monthly, "low_charge", "feature_upsell", 0),
        (contract == "Two year", "two_year", "loyalty_reward", 0),
        (high & rich, "max", "discount_offer", cfg.discount_max_pct),
        (high & fair, "mid", "discount_offer", cfg.discount_mid_pct),
        (flagged & rich, "min", "discount_offer", cfg.discount_min_pct),
        (F.lit(True), "none", "engagement_campaign", 0),
    ]
    chain = None
    for condition, why, strategy, pct in rules:
        saving = monthly * pct / 100
        nothing = F.lit(None).cast("double")
        outcome = F.struct(
            F.lit(pct > 0).alias("eligible"),
            render(DISCOUNT_REASONS[why], words).alias("reason"),
            F.lit(pct).alias("discount_pct"),
            F.lit(strategy).alias("strategy"),
            value.alias("ltv"),
            (round_exact(saving, 2) if pct else nothing).alias("monthly_savings"),
            (round_exact(saving * 12, 2) if pct else nothing).alias("annual_savings"),
        )
        chain = F.when(condition, outcome) if chain is None else chain.when(condition, outcome)
    return chain


def with_discount(df: DataFrame, prob: str = "churn_prob", cfg: DecisionConfig = CONFIG) -> DataFrame:
    """Adds the discount columns to rows that carry the decision profile."""
    tenure, monthly = F.col("tenure"), F.col("MonthlyCharges")
    valued = df.withColumn("_value", ltv(tenure, monthly))
    decided = valued.withColumn(
        "_d", assess_discount(tenure, monthly, F.col("contract_type"), F.col(prob), cfg, F.col("_value"))
    )
    names = ("eligible", "discount_pct", "strategy", "ltv", "monthly_savings", "annual_savings")
    return decided.withColumns(
        {**{n: F.col(f"_d.{n}") for n in names}, "discount_reason": F.col("_d.reason")}
    ).drop("_d", "_value")
