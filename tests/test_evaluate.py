from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepline.operators.evaluate import (
    class_report, compare_models, confusion_matrix, evaluate, evaluate_models, roc_auc,
    roc_comparison, roc_curve, threshold_metrics, with_prediction,
)
from keepline.plans.reports import append_section, markdown, model_report


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 700)
    score = np.round(np.clip(rng.normal(0.4 + 0.15 * y, 0.2), 0, 1), 2)  # many ties
    score[:250] = 0.5  # a third of all rows share one score
    return [(float(s), int(t)) for s, t in zip(score, y)]


@pytest.fixture(scope="module")
def scored(spark, rows):
    return spark.createDataFrame(rows, "p double, y int")


def brute_auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_counts_pairs(scored, rows):
    for buckets in (1, 4, 256):
        assert abs(roc_auc(scored, "p", "y", buckets).first()[0] - brute_auc(rows)) < 1e-12


def test_auc_needs_both_classes(spark, scored):
    assert roc_auc(scored.where("y = 1"), "p", "y").first()[0] is None
    assert roc_auc(scored.where("y > 5"), "p", "y").first()[0] is None


def test_curve(scored, rows):
    points = sorted((r["fpr"], r["tpr"]) for r in roc_curve(scored, "p", "y", 4).collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    assert len(points) == len({s for s, _ in rows}) + 1
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert abs(area - brute_auc(rows)) < 1e-12


def test_thinned_comparison_keeps_the_end(scored):
    got = roc_comparison(scored.withColumn("q", 1 - F.col("p")), {"a": "p", "b": "q"}, "y", points=10).collect()
    for m in ("a", "b", "random"):
        mine = [(r["fpr"], r["tpr"]) for r in got if r["model"] == m]
        assert (1.0, 1.0) in mine and len(mine) <= 12


def test_metrics(scored, rows):
    pred = with_prediction(scored, "p", 0.5)
    tp = sum(1 for s, y in rows if s >= 0.5 and y)
    fp = sum(1 for s, y in rows if s >= 0.5 and not y)
    fn = sum(1 for s, y in rows if s < 0.5 and y)
    tn = len(rows) - tp - fp - fn
    cells = {(r["actual"], r["predicted"]): r["n"] for r in confusion_matrix(pred, "y").collect()}
    assert cells == {(0, 0): tn, (0, 1): fp, (1, 0): fn, (1, 1): tp}
    m = threshold_metrics(pred, "y").first()
    assert m["accuracy"] == round((tp + tn) / len(rows), 4)
    assert m["precision"] == round(tp / (tp + fp), 4) and m["recall"] == round(tp / (tp + fn), 4)
    long = {r["metric"]: r["value"] for r in evaluate(scored, "m", "p", "y").collect()}
    assert long["f1"] == m["f1"] and long["roc_auc"] == round(brute_auc(rows), 4)
    report = {r["class"]: r for r in class_report(pred, "y").collect()}
    assert report["Churn"]["support"] == tp + fn
    assert abs(report["macro avg"]["recall"] - (tp / (tp + fn) + tn / (tn + fp)) / 2) < 1e-12


def test_nothing_predicted(spark):
    rows = with_prediction(spark.createDataFrame([(0.1, 1), (0.2, 0)], "p double, y int"), "p")
    m = threshold_metrics(rows, "y").first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    empty = threshold_metrics(rows.where("p > 1"), "y").first()
    assert empty["accuracy"] == 0.0


def test_comparison_and_report(spark, tmp_path):
    metrics = spark.createDataFrame(
        [("a", 1, "accuracy", 0.76), ("b", 1, "accuracy", 0.8), ("a", 5, "roc_auc", 0.9), ("b", 5, "roc_auc", 0.87)],
        "model string, ordinal int, metric string, value double",
    )
    got = {r["metric"]: r for r in compare_models(metrics, "a", "b").collect()}
    assert got["accuracy"]["direction"] == "↑" and abs(got["accuracy"]["delta_pp"] - 4) < 1e-9
    assert got["roc_auc"]["direction"] == "↓"
    text = {r["metric_label"]: tuple(r)[2:] for r in model_report(metrics, "a", "b").collect()}
    assert text["Accuracy"] == ("76.00%", "80.00%", "+4.00%") and text["ROC-AUC"][2] == "-3.00%"
    page = markdown("Comparison", model_report(metrics, "a", "b"), "ordinal")
    path = tmp_path / "report.md"
    append_section(str(path), page)
    append_section(str(path), page)
    assert path.read_text().count("| Accuracy | 76.00% |") == 2
    with pytest.raises(ValueError):
        markdown("big", spark.range(1000))


def test_rows_without_a_score_are_an_error(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.2, 0), (float("nan"), 1), (None, 0)], "p double, y int")
    for use in (lambda: evaluate(rows, "m", "p", "y"), lambda: roc_curve(rows, "p", "y"), lambda: roc_auc(rows, "p", "y")):
        with pytest.raises(ValueError, match="2 rows"):
            use()


def test_several_models_in_the_same_passes(spark):
    """As one by one, with ties and over several buckets; the scores are grouped and stored once."""
    rng = np.random.default_rng(8)
    rows = [(float(rng.integers(0, 40)) / 40, float(rng.random()), int(rng.random() < 0.3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "p double, q double, y int").repartition(4)
    for buckets in (None, 1, 7):
        both = evaluate_models(df, {"one": "p", "two": "q"}, "y", buckets=buckets)
        alone = evaluate(df, "one", "p", "y").unionByName(evaluate(df, "two", "q", "y"))
        assert sorted(map(tuple, both.collect())) == sorted(map(tuple, alone.collect()))
        assert both.columns == alone.columns
    assert evaluate_models(df.where("p > 1"), {"one": "p", "two": "q"}, "y").count() == 0
    lost = spark.createDataFrame([(0.9, None, 1), (0.2, 0.1, 0)], "p double, q double, y int")
    with pytest.raises(ValueError, match="1 rows"):
        evaluate_models(lost, {"one": "p", "two": "q"}, "y")
