"""Scored customers to retention outcomes, for a whole table at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepline.functions.numbers import percent_text, round_exact
from keepline.functions.text import render
from keepline.operators.decide import CONFIG, detect_behavior, is_flagged, with_discount
from keepline.operators.explain import explain
from keepline.operators.messages import is_written, parse_message
from keepline.roles import IDLE_REASON, DecisionConfig


def flagged_decisions(
    scored: DataFrame,
    key: str,
    replies: DataFrame | None = None,
    prob: str = "churn_prob",
    cfg: DecisionConfig = CONFIG,
    attribute: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Flagged customers with reasons, risk type and discount.

    ``scored`` carries key, score and decision profile, and ``contributions`` unless
    ``attribute`` adds them. The threshold comes first, so everything after it, the costly
    attribution above all, runs on flagged rows only.
    """
    flagged = scored.where(is_flagged(F.col(prob), cfg))
    if attribute is not None:
        flagged = attribute(flagged)
    return with_discount(detect_behavior(explain(flagged), key, replies), prob, cfg)


def decide(
    scored: DataFrame,
    key: str,
    replies: DataFrame | None = None,
    texts: DataFrame | None = None,
    prob: str = "churn_prob",
    cfg: DecisionConfig = CONFIG,
    attribute: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per customer: the full outcome, or no action with its reason.

    ``replies`` (key, reply) settles unclear risk types; ``texts`` (key, text) holds the
    written messages.
    """
    decided = with_texts(flagged_decisions(scored, key, replies, prob, cfg, attribute), key, texts)
    return sent_outcomes(decided, key, prob).unionByName(
        idle_outcomes(scored, key, prob, cfg), allowMissingColumns=True
    )


def with_texts(decided: DataFrame, key: str, texts: DataFrame | None) -> DataFrame:
    """Adds the written message of each decided customer; null where none is there yet."""
    if texts is None:
        return decided.withColumn("text", F.lit(None).cast("string"))
    return decided.join(texts.groupBy(key).agg(F.max("text").alias("text")), key, "left")


def sent_outcomes(decided: DataFrame, key: str, prob: str = "churn_prob") -> DataFrame:
    """Outcome rows of flagged customers: 'email_sent' with a written message, 'pending' until then."""
    written = is_written(F.col("text"))
    return decided.select(
        F.col(key).alias("user_id"),
        round_exact(F.col(prob), 4).alias("churn_prob"),
        "risk_type",
        "confidence",
        "discount_pct",
        "eligible",
        F.when(written, parse_message(F.col("text"))["subject"]).alias("email_subject"),
        "strategy",
        F.col("reasons").alias("top_reasons"),
        F.when(written, F.lit("email_sent")).otherwise(F.lit("pending")).alias("action"),
        F.lit(None).cast("string").alias("reason"),
    )


def idle_outcomes(
    scored: DataFrame, key: str, prob: str = "churn_prob", cfg: DecisionConfig = CONFIG
) -> DataFrame:
    """Outcome rows of customers below the threshold."""
    words = {"prob": percent_text(F.col(prob), 1), "threshold": F.lit(str(cfg.flag_threshold))}
    return scored.where(~is_flagged(F.col(prob), cfg)).select(
        F.col(key).alias("user_id"),
        F.col(prob).alias("churn_prob"),
        F.lit("no_action").alias("action"),
        render(IDLE_REASON, words).alias("reason"),
    )
