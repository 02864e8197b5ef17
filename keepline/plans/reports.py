"""Run report and model-comparison report: small tables, with Markdown on request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepline.functions.numbers import fixed_text, percent_text, signed_text
from keepline.operators.evaluate import compare_models
from keepline.plans.marts import first_flagged, risk_type_breakdown, run_summary

# Row labels of the summary, in report order.
SUMMARY_LABELS = {
    "processed": "Total users processed",
    "flagged": "Flagged (above threshold)",
    "skipped": "Below threshold (no action)",
    "messages": "Emails generated",
    "pending": "Emails not yet written",
    "eligible": "Discount eligible",
    "mean_prob": "Avg churn probability",
}
METRIC_LABELS = {
    "accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1-Score",
    "roc_auc": "ROC-AUC",
}
MAX_REPORT_ROWS = 100


@dataclass
class RunReport:
    summary: DataFrame
    breakdown: DataFrame
    flagged: DataFrame


def summary_lines(outcomes: DataFrame, scored: DataFrame) -> DataFrame:
    """(ordinal, metric, value) as the run report prints them."""
    wide = run_summary(outcomes, scored)
    rows = []
    for i, (c, label) in enumerate(SUMMARY_LABELS.items()):
        value = percent_text(F.col(c), 1) if c == "mean_prob" else F.format_number(F.col(c), 0)
        rows.append(F.struct(F.lit(i + 1).alias("ordinal"), F.lit(label).alias("metric"), value.alias("value")))
    return wide.select(F.inline(F.array(*rows)))


def run_report(outcomes: DataFrame, scored: DataFrame, n: int = 20) -> RunReport:
    """Summary, risk types and first flagged customers of one run."""
    types = risk_type_breakdown(outcomes)
    shown = types.withColumn("pct_text", F.concat(fixed_text(F.col("pct_of_flagged"), 1), F.lit("%")))
    return RunReport(summary_lines(outcomes, scored), shown, first_flagged(outcomes, n))


def model_report(metrics: DataFrame, base: str, new: str) -> DataFrame:
    """(metric, base, new, improvement) in percent text."""
    label = F.col("metric")
    for m, text in METRIC_LABELS.items():
        label = F.when(F.col("metric") == m, F.lit(text)).otherwise(label)

    def percent(c: str):
        return F.concat(fixed_text(F.col(c) * 100, 2), F.lit("%"))

    return compare_models(metrics, base, new).select(
        "ordinal",
        label.alias("metric_label"),
        percent("base").alias("base_text"),
        percent("new").alias("new_text"),
        F.concat(signed_text((F.col("new") - F.col("base")) * 100, 2), F.lit("%")).alias("improvement"),
    )


def markdown(title: str, table: DataFrame, order: str | None = None) -> str:
    """A small table as Markdown; more rows than a report holds is an error."""
    rows = (table.orderBy(order) if order else table).limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError("too many rows for a report")
    head = "| " + " | ".join(table.columns) + " |"
    rule = "|" + "---|" * len(table.columns)
    lines = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join([f"## {title}", "", head, rule, *lines, ""])


def write_page(spark: SparkSession, text: str, path: str) -> None:
    """A report page as one text file in a folder that Spark writes, wherever that is."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_section(path: str, text: str) -> None:
    """Add a section to a Markdown report file."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(text + "\n")
