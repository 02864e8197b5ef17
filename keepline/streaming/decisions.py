"""Decisions for customers as they arrive.

Scoring, attribution and the rules are stateless column expressions, so a stream runs the same
plan as a batch. Only repeated deliveries need state, and that is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keepline.operators.clean import coerce_numeric, impute_constant
from keepline.operators.decide import CONFIG
from keepline.operators.explain import linear_contributions
from keepline.operators.features import engineer
from keepline.operators.score import linear_score
from keepline.plans.decisions import flagged_decisions
from keepline.roles import TELCO, DecisionConfig, Roles


def decide_arrivals(
    arrivals: DataFrame,
    coefficients: DataFrame,
    means: DataFrame,
    event_time: str | None = None,
    delay: str = "1 hour",
    roles: Roles = TELCO,
    cfg: DecisionConfig = CONFIG,
) -> DataFrame:
    """Flagged arrivals with reasons, risk type and offer.

    With ``event_time``, a customer delivered twice within ``delay`` is decided once.
    """
    rows = arrivals
    if event_time:
        rows = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([roles.key])
    numbers = list(roles.text_numeric)
    ready = engineer(impute_constant(coerce_numeric(rows, numbers), numbers), roles)
    scored = linear_contributions(linear_score(ready, coefficients), coefficients, means)
    return flagged_decisions(scored.withColumn("contract_type", F.col("Contract")), roles.key, cfg=cfg)


def start_decisions(decisions: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append decisions to a Parquet folder; the file sink commits each batch exactly once."""
    columns = [
        TELCO.key, "churn_prob", "risk_type", "method", "confidence", "routing", "eligible",
        "discount_pct", "strategy", "discount_reason", "ltv", "reasons",
    ]
    return (
        decisions.select(*columns)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
