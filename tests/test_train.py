from __future__ import annotations

import numpy as np
import pytest
from planted import planted
from pyspark.sql import functions as F

from keepline.operators.clean import coerce_numeric
from keepline.operators.evaluate import evaluate
from keepline.operators.score import linear_score, score
from keepline.operators.train import (
    balanced_weights, coefficient_table, feature_names, importance_table, pos_weight,
    pos_weight_ratio, top_coefficients, top_importances, train_boosted, train_logistic,
)
from keepline.plans.preprocess import preprocess
from keepline.sources.artefacts import load_model, load_params, save_model, save_params

LABEL = "Churn_Binary"


@pytest.fixture(scope="module")
def ready(spark):
    p = preprocess(planted(spark))
    p.features = p.features.cache()
    return p


def side(ready, name):
    return ready.features.where(F.col("split") == name)


def test_preprocess_shape(ready):
    assert len(ready.names) == 4 + 11 + 10 + 12
    counts = {r["split"]: r["count"] for r in ready.features.groupBy("split").count().collect()}
    assert counts == {"train": 3200, "test": 800}
    train = side(ready, "train").agg(*[F.avg(f"`{c}`").alias(c) for c in ready.scaled_names]).first()
    assert max(abs(v) for v in train) < 1e-9
    spread = side(ready, "train").agg(*[F.stddev_pop(f"`{c}`").alias(c) for c in ready.scaled_names]).first()
    assert all(abs(v - 1) < 1e-9 for v in spread)
    assert ready.features.where(F.col("TotalCharges").isNull()).count() == 0


def test_fit_on_all_uses_the_whole_table(spark):
    raw = planted(spark, 1000)
    whole = preprocess(raw, fit_on="all").medians.first()[0]
    known = [r[0] for r in coerce_numeric(raw, ["TotalCharges"]).select("TotalCharges").collect() if r[0] is not None]
    assert whole == float(np.median(known))


def test_weights(ready):
    train = side(ready, "train")
    totals = balanced_weights(train, LABEL).groupBy(LABEL).agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r["w"] - 1600) < 1e-6 for r in totals)
    ratio = pos_weight_ratio(train, LABEL).first()
    assert ratio["ratio"] == float(np.round(ratio["neg"] / ratio["pos"], 2))
    assert pos_weight(train, LABEL).where(F.col(LABEL) == 1).first()["weight"] == ratio["ratio"]
    with pytest.raises(ValueError):
        pos_weight(train.where(F.col(LABEL) == 0), LABEL)


def test_logistic_matches_newton(ready):
    """Same optimum as solving the penalised weighted likelihood directly."""
    names = ["tenure_scaled", "is_monthly_scaled", "is_fiber_scaled", "no_security_scaled"]
    train = balanced_weights(side(ready, "train"), LABEL)
    model = train_logistic(train, names, LABEL)
    data = np.array([tuple(r) for r in train.select(*names, LABEL, "weight").collect()])
    x, y, w = np.c_[np.ones(len(data)), data[:, :4]], data[:, 4], data[:, 5]
    beta, ridge = np.zeros(5), np.diag([0.0, 1, 1, 1, 1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (p - y)) + ridge @ beta
        beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, grad)
    got = [r["weight"] for r in coefficient_table(model, train).orderBy("ordinal").collect()]
    np.testing.assert_allclose(got, beta, atol=2e-4)


@pytest.fixture(scope="module")
def logistic(ready):
    return train_logistic(balanced_weights(side(ready, "train"), LABEL), ready.scaled_names, LABEL)


@pytest.fixture(scope="module")
def boosted(ready):
    return train_boosted(pos_weight(side(ready, "train"), LABEL), ready.names, LABEL, maxIter=10, maxDepth=3)


def auc(df, prob="churn_prob"):
    return {r["metric"]: r["value"] for r in evaluate(df, "m", prob, LABEL).collect()}["roc_auc"]


def test_models_learn_the_planted_signal(ready, logistic, boosted):
    test = side(ready, "test")
    assert auc(score(logistic, test)) > 0.75
    assert auc(score(boosted, test)) > 0.72
    top = [r["feature"] for r in top_importances(importance_table(boosted, test), 6).collect()]
    assert "tenure" in top or "recency_score" in top
    weights = top_coefficients(coefficient_table(logistic, test)).collect()
    assert len(weights) == 15 and [r["weight"] for r in weights] == sorted(r["weight"] for r in weights)


def test_coefficient_table_serves_the_model(ready, logistic):
    test = side(ready, "test")
    both = linear_score(score(logistic, test, "by_model"), coefficient_table(logistic, test), "by_table")
    assert both.agg(F.max(F.abs(F.col("by_model") - F.col("by_table")))).first()[0] < 1e-12


def test_artefacts_survive(spark, ready, logistic, boosted, tmp_path):
    test = side(ready, "test")
    for name, model in (("lr", logistic), ("gbt", boosted)):
        path = str(tmp_path / name)
        save_model(model, path)
        loaded = load_model(path)
        assert feature_names(loaded) == feature_names(model)
        want = [r[0] for r in score(model, test).orderBy("customerID").select("churn_prob").collect()]
        assert [r[0] for r in score(loaded, test).orderBy("customerID").select("churn_prob").collect()] == want
    save_params(ready.scaler, str(tmp_path / "scaler"))
    assert sorted(load_params(spark, str(tmp_path / "scaler")).collect()) == sorted(ready.scaler.collect())
