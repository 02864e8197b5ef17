"""Model evaluation, exact at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepline.functions.numbers import round_exact, safe_divide
from keepline.operators.ranks import value_totals
from keepline.roles import METRICS

METRIC_DIGITS = 4


def with_prediction(df: DataFrame, prob: str, threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, (F.col(prob) >= threshold).cast("int"))


def _cells(label: str, prediction: str) -> list[Column]:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return [
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"),
    ]


def confusion_matrix(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Four rows (actual, predicted, n); empty cells are zero."""
    cells = df.agg(*_cells(label, prediction))
    order = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
        for a, p, c in order
    ]
    return cells.select(F.inline(F.array(*rows)))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1 of the positive class; 0/0 counts as 0."""
    return {
        "accuracy": safe_divide(tp + tn, tp + tn + fp + fn),
        "precision": safe_divide(tp, tp + fp),
        "recall": safe_divide(tp, tp + fn),
        "f1": safe_divide(2 * tp, 2 * tp + fp + fn),
    }


def threshold_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row of rates for given predictions."""
    rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return df.agg(*_cells(label, prediction)).select(
        *[round_exact(v, METRIC_DIGITS).alias(k) for k, v in rates.items()]
    )


def _ranked(df: DataFrame, prob: str, label: str, buckets: int | None) -> DataFrame:
    """One row per distinct score with running positives and negatives from the top.

    A row without a usable score is an error: nothing is left out of an evaluation silently.
    """
    rows = df.select((-F.col(prob)).alias("neg_score"), F.col(label).cast("long").alias("y"))
    sums = {"pos": F.col("y"), "neg": F.lit(1).cast("long") - F.col("y")}
    return value_totals(rows, "neg_score", sums, buckets)


def roc_auc(df: DataFrame, prob: str, label: str, buckets: int | None = None) -> DataFrame:
    """One row: the exact area under the ROC curve, ties counted half; null for one class only."""
    return _ranked(df, prob, label, buckets).agg(*_area()).select(_auc().alias("roc_auc"))


def _area() -> list[Column]:
    above = F.col("cum_pos") - F.col("pos")
    return [
        F.sum(F.col("neg") * (above + F.col("pos") / 2)).alias("area"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    ]


def _auc() -> Column:
    return F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area") / F.col("p") / F.col("n"))


def roc_curve(df: DataFrame, prob: str, label: str, buckets: int | None = None) -> DataFrame:
    """Every point of the ROC curve: (threshold, fpr, tpr), the origin included."""
    ranked = _ranked(df, prob, label, buckets)
    totals = ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    pos, neg = totals.select("p").scalar(), totals.select("n").scalar()
    points = ranked.select(
        (-F.col("neg_score")).alias("threshold"),
        safe_divide(F.col("cum_neg"), neg, None).alias("fpr"),
        safe_divide(F.col("cum_pos"), pos, None).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return origin.unionByName(points)


def roc_comparison(
    df: DataFrame, probs: dict[str, str], label: str, points: int | None = None, buckets: int | None = None
) -> DataFrame:
    """ROC points of several models, plus the diagonal, as (model, threshold, fpr, tpr).

    ``points`` thins each curve for drawing to its last point per step of the false positive
    rate; leave it out for the whole curve.
    """
    diagonal = df.sparkSession.createDataFrame(
        [("random", None, 0.0, 0.0), ("random", None, 1.0, 1.0)],
        "model string, threshold double, fpr double, tpr double",
    )
    out = diagonal
    for name, prob in probs.items():
        curve = roc_curve(df, prob, label, buckets)
        if points:
            curve = (
                curve.groupBy(F.floor(F.col("fpr") * points).alias("step"))
                .agg(F.max(F.struct("tpr", "fpr", "threshold")).alias("p"))
                .select("p.threshold", "p.fpr", "p.tpr")
            )
        out = out.unionByName(curve.withColumn("model", F.lit(name)))
    return out


def evaluate(
    df: DataFrame, model: str, prob: str, label: str, threshold: float = 0.5, buckets: int | None = None
) -> DataFrame:
    """Long metric table (model, metric, value), values to four decimals.

    All five come from the same per-score totals, so the rows are grouped once.
    """
    sums = _ranked(df, prob, label, buckets).agg(*_area(), *_above(threshold))
    return _metric_rows(sums, F.lit(model))


def evaluate_models(
    df: DataFrame, probs: dict[str, str], label: str, threshold: float = 0.5, buckets: int | None = None
) -> DataFrame:
    """``evaluate`` for several models whose scores stand side by side (name: column), in the same passes.

    The table is read once; each row counts once per model, before anything is shuffled. Without rows
    there are no metrics.
    """
    scores = [F.struct(F.lit(m).alias("model"), (-F.col(p)).alias("neg_score")) for m, p in probs.items()]
    rows = df.select(F.col(label).cast("long").alias("y"), F.inline(F.array(*scores)))
    sums = {"pos": F.col("y"), "neg": F.lit(1).cast("long") - F.col("y")}
    totals = value_totals(rows, "neg_score", sums, buckets, by="model")
    return _metric_rows(totals.groupBy("model").agg(*_area(), *_above(threshold)), F.col("model"))


def _above(threshold: float) -> list[Column]:
    above_cut = F.col("neg_score") <= -threshold
    return [F.sum(F.when(above_cut, F.col(n)).otherwise(0)).alias(to) for n, to in (("pos", "tp"), ("neg", "fp"))]


def _metric_rows(sums: DataFrame, model: Column) -> DataFrame:
    tp, fp = F.col("tp"), F.col("fp")
    values = {**_rates(tp, fp, F.col("p") - tp, F.col("n") - fp), "roc_auc": _auc()}
    wide = sums.select(model.alias("model"), *[round_exact(v, METRIC_DIGITS).alias(k) for k, v in values.items()])
    rows = [
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(m).alias("metric"), F.col(m).alias("value"))
        for i, m in enumerate(METRICS)
    ]
    return wide.select("model", F.inline(F.array(*rows)))


def class_report(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with plain and support-weighted averages."""
    c = {k: F.col(k) for k in ("tn", "fp", "fn", "tp")}
    neg, pos = c["tn"] + c["fp"], c["fn"] + c["tp"]
    total = neg + pos

    def f1(tp, fp, fn):
        return safe_divide(2 * tp, 2 * tp + fp + fn)

    metrics = {
        "precision": (safe_divide(c["tn"], c["tn"] + c["fn"]), safe_divide(c["tp"], c["tp"] + c["fp"])),
        "recall": (safe_divide(c["tn"], neg), safe_divide(c["tp"], pos)),
        "f1": (f1(c["tn"], c["fn"], c["fp"]), f1(c["tp"], c["fp"], c["fn"])),
    }

    def row(name: str, pick, support) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[pick(a, b).alias(m) for m, (a, b) in metrics.items()],
            support.alias("support"),
        )

    rows = [
        row("No Churn", lambda a, b: a, neg),
        row("Churn", lambda a, b: b, pos),
        row("macro avg", lambda a, b: (a + b) / 2, total),
        row("weighted avg", lambda a, b: safe_divide(a * neg + b * pos, total), total),
    ]
    return df.agg(*_cells(label, prediction)).select(F.inline(F.array(*rows)))


def metrics_side_by_side(metrics: DataFrame, base: str, new: str) -> DataFrame:
    """(metric, base, new): the two models' values in one row per metric."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("value")))
    return (
        metrics.where(F.col("model").isin(base, new))
        .groupBy("ordinal", "metric")
        .agg(of(base).alias("base"), of(new).alias("new"))
    )


def compare_models(metrics: DataFrame, base: str, new: str) -> DataFrame:
    """Per metric: base, new, difference in percentage points and its direction."""
    delta = (F.col("new") - F.col("base")) * 100
    return metrics_side_by_side(metrics, base, new).select(
        "ordinal",
        "metric",
        "base",
        "new",
        delta.alias("delta_pp"),
        F.when(delta > 0, F.lit("↑")).otherwise(F.lit("↓")).alias("direction"),
    )
