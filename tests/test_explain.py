from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keepline.operators.boost import BoostedTrees
from keepline.operators.explain import (
    as_map, customer_features, explain, extreme_customers, feature_means, global_importance,
    largest_contributions, linear_contributions, linear_margins, risk_hint, total_contribution, waterfall,
)
from keepline.operators.score import coefficient_frame, linear_score, score
from keepline.operators.train import train_boosted
from keepline.operators.tree_shap import (
    chunks_of, node_table, read_nodes, sample_contributions, tree_contributions, tree_tables,
)
from keepline.session import as_table

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] + x[:, 1] * x[:, 3] + 0.3 * rng.normal(size=600) > 0).astype(int)
    data = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, d double, y int").withColumn("weight", F.lit(1.0))


def expected_value(tree, node_id, x, known):
    """Mean leaf value when only the ``known`` features of x are given."""
    n = tree[node_id]
    if n["left"] < 0:
        return n["prediction"]
    if n["feature"] in known:
        return expected_value(tree, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"], x, known)
    return sum(
        tree[c]["cover"] / n["cover"] * expected_value(tree, c, x, known) for c in (n["left"], n["right"])
    )


def brute_shapley(nodes, x):
    trees = {}
    for n in nodes:
        trees.setdefault(n["treeID"], {})[n["id"]] = n
    d = len(x)

    def v(known):
        return sum(2 * next(iter(t.values()))["weight"] * expected_value(t, 0, x, known) for t in trees.values())

    phi = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for k in range(d):
            for s in itertools.combinations(rest, k):
                w = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                phi[i] += w * (v({*s, i}) - v(set(s)))
    return v(set()), phi


@pytest.mark.parametrize("depth", [2, 4, 10])
def test_tree_contributions_are_shapley_values(spark, rows, depth):
    model = train_boosted(rows, FEATURES, "y", maxIter=3, maxDepth=depth, stepSize=0.3)
    nodes = node_table(model, spark)
    explained = tree_contributions(score(model, rows), model, nodes)
    node_rows = nodes.collect()
    sample = explained.where("id < 12").collect()
    assert len(sample) == 12
    for r in sample:
        base, phi = brute_shapley(node_rows, [r[f] for f in FEATURES])
        assert abs(r["base_value"] - base) < 1e-9
        assert [c["feature"] for c in r["contributions"]] == FEATURES
        np.testing.assert_allclose([c["contribution"] for c in r["contributions"]], phi, atol=1e-9)
    gap = explained.select(
        F.max(F.abs(F.col("base_value") + total_contribution(F.col("contributions")) - F.log(F.col("churn_prob") / (1 - F.col("churn_prob")))))
    ).first()[0]
    assert gap < 1e-9


KINDS = "treeID int, weight double, id int, prediction double, cover double, left int, right int, feature int, threshold double, n_categories int"


def grown(rng, n_leaves: int, n_features: int, tree: int = 0, balanced: bool = False) -> list[tuple]:
    """A random tree as rows of a node table; unbalanced trees have long paths."""
    split, children, open_ = {}, {}, [0]
    while len(open_) < n_leaves:
        i = open_.pop(0 if balanced else -1 if rng.random() < 0.7 else int(rng.integers(len(open_))))
        split[i] = (int(rng.integers(n_features)), float(np.round(rng.normal(), 2)))
        children[i] = (len(split) * 2 - 1, len(split) * 2)
        open_ += children[i]
    cover = {i: float(rng.integers(1, 50)) for i in open_}
    for i in sorted(children, reverse=True):
        cover[i] = cover[children[i][0]] + cover[children[i][1]]
    value = rng.normal(size=len(cover))
    return [
        (tree, 0.5, i, float(value[i]), cover[i], *children.get(i, (-1, -1)), *split.get(i, (-1, None)), -1)
        for i in sorted(cover)
    ]


def margins(nodes: list[tuple], x) -> float:
    trees, total = {}, 0.0
    for n in nodes:
        trees.setdefault(n[0], {})[n[2]] = n
    for t in trees.values():
        n = t[0]
        while n[5] >= 0:
            n = t[n[5] if x[n[7]] <= n[8] else n[6]]
        total += n[3]
    return total


def longest_path(nodes) -> int:
    """Different features on one path, from the tables."""
    return max(int(t.used.max()) for t in nodes)


@pytest.mark.parametrize("chunk_nodes", [200_000, 30])
def test_long_paths_are_shapley_values(spark, chunk_nodes):
    """Paths over twelve features, beyond what is tabulated, in one chunk of trees and in several."""
    rng = np.random.default_rng(8)
    names = [f"x{i}" for i in range(12)]
    rows = [r for t in range(2) for r in grown(rng, 40, 12, t)]
    nodes = spark.createDataFrame(rows, KINDS)
    tables, _ = tree_tables(nodes)
    assert longest_path(tables) >= 11 and any(t.table is None for t in tables)
    x = rng.normal(size=(3, 12))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names))
    assert len(chunks_of(nodes, chunk_nodes)) == (1 if chunk_nodes > 200 else 2)
    got = tree_contributions(df, BoostedTrees(names, [], []), nodes, chunk_nodes=chunk_nodes).orderBy("id").collect()
    cached = {}
    tree = {t: {n["id"]: n for n in nodes.collect() if n["treeID"] == t} for t in range(2)}

    def v(i, known):
        if (i, known) not in cached:
            cached[i, known] = sum(expected_value(t, 0, x[i], known) for t in tree.values())
        return cached[i, known]

    for i, r in enumerate(got):
        assert abs(r["base_value"] - v(i, frozenset())) < 1e-9
        for f in range(12):
            rest = [j for j in range(12) if j != f]
            want = sum(
                math.factorial(k) * math.factorial(11 - k) / math.factorial(12)
                * (v(i, frozenset(s) | {f}) - v(i, frozenset(s)))
                for k in range(12) for s in itertools.combinations(rest, k)
            )
            assert abs(r["contributions"][f]["contribution"] - want) < 1e-9


def test_models_of_any_size_add_up(spark):
    """A tree of 262,143 nodes beside small ones: nothing is refused, contributions add up to the margin."""
    rng = np.random.default_rng(9)
    names = [f"x{i}" for i in range(12)]
    rows = [r for t, n in enumerate([5, 2**17, 9]) for r in grown(rng, n, 12, t, balanced=True)]
    nodes = as_table(spark.createDataFrame(pd.DataFrame(rows, columns=[k.split()[0] for k in KINDS.split(", ")]), KINDS), "nodes")
    assert len(chunks_of(nodes)) == 3
    x = rng.normal(size=(20, 12))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names))
    for r in tree_contributions(df, BoostedTrees(names, [], []), nodes).collect():
        total = r["base_value"] + sum(c["contribution"] for c in r["contributions"])
        assert abs(total - margins(rows, x[r["id"]])) < 1e-8


def test_tables_follow_the_tree_depth(spark, rows):
    shallow = train_boosted(rows, FEATURES, "y", maxIter=1, maxDepth=2)
    deep = train_boosted(rows, FEATURES, "y", maxIter=1, maxDepth=0)
    assert all(t.table is not None for t in tree_tables(node_table(shallow, spark))[0])
    stump, base = tree_tables(node_table(deep, spark))
    assert len(stump[0].value) == 1 and abs(base - stump[0].value[0]) < 1e-12


def test_no_rows_to_explain(spark, rows):
    model = train_boosted(rows, FEATURES, "y", maxIter=2, maxDepth=2)
    none = tree_contributions(score(model, rows.where("id < 0")), model)
    assert none.collect() == []
    assert sample_contributions(rows, model, "id", 50).count() == 50


def test_saved_model_gives_the_same_nodes(spark, rows, tmp_path):
    model = train_boosted(rows, FEATURES, "y", maxIter=2, maxDepth=2)
    path = str(tmp_path / "model")
    model.stages[-1].write().save(path)
    key = lambda r: (r["treeID"], r["id"])
    assert sorted(read_nodes(spark, path).collect(), key=key) == sorted(node_table(model, spark).collect(), key=key)


# ---- linear ---------------------------------------------------------------------------------

WEIGHTS = {"a": 1.0, "b": -0.5, "c": 0.25, "d": 0.0}


@pytest.fixture(scope="module")
def linear(spark, rows):
    coefs = coefficient_frame(spark, WEIGHTS, -0.3)
    return linear_score(linear_margins(linear_contributions(rows, coefs, feature_means(rows, FEATURES)), coefs), coefs)


def test_linear_contributions_add_up(linear):
    gap = F.abs(F.col("base_value") + total_contribution(F.col("contributions")) - F.col("margin"))
    prob = F.abs(1 / (1 + F.exp(-F.col("margin"))) - F.col("churn_prob"))
    assert tuple(linear.agg(F.max(gap) < 1e-12, F.max(prob) < 1e-15).first()) == (True, True)
    centred = linear.select(F.inline("contributions")).groupBy("feature").agg(F.abs(F.avg("contribution")).alias("m"))
    assert centred.agg(F.max("m")).first()[0] < 1e-12


def test_reasons_keep_feature_order_on_ties(spark):
    pairs = [("tenure", 0.2), ("my_feature", 0.5), ("is_fiber", 0.5), ("is_monthly", -0.1), ("TechSupport", 0.0), ("x", -0.4)]
    rows = spark.createDataFrame([(1, pairs)], "id int, contributions array<struct<feature:string,contribution:double>>")
    done = explain(rows).withColumns({"up": F.map_keys("top_positive"), "down": F.map_keys("top_negative")})
    r = done.first()
    assert [x["feature"] for x in r["top_reasons"]] == ["my_feature", "is_fiber", "tenure"]
    assert [x["reason"] for x in r["top_reasons"]] == [
        "my feature", "fiber optic internet (high churn segment)", "very short account tenure",
    ]
    assert r["up"] == ["my_feature", "is_fiber", "tenure", "TechSupport", "is_monthly"]
    assert r["down"] == ["x", "is_monthly", "TechSupport"]
    assert r["risk_hint"] == "disengagement" and r["shap_scores"]["x"] == -0.4
    strict = explain(rows, positive_only=True).first()
    assert set(strict["top_positive"]) == {"my_feature", "is_fiber", "tenure"}
    hint = rows.select(risk_hint(F.array(F.struct(F.lit("no_security").alias("feature"), F.lit(0.1).alias("contribution")))).alias("h"))
    assert hint.first()["h"] == "support_issue"
    big = rows.select(F.map_keys(as_map(largest_contributions(F.col("contributions"), 3))).alias("m")).first()["m"]
    assert big == ["my_feature", "is_fiber", "x"]


def test_empty_contributions(spark):
    rows = spark.createDataFrame([(1, [])], "id int, contributions array<struct<feature:string,contribution:double>>")
    r = explain(rows).first()
    assert r["top_reasons"] == [] and r["top_positive"] == {} and r["risk_hint"] == "disengagement"


def test_waterfall_and_views(linear):
    steps = waterfall(linear, "id", 3, n=2).orderBy("step").collect()
    assert [s["feature"] for s in steps][0] == "(base)" and len(steps) == 5
    assert abs(sum(s["contribution"] for s in steps[:-1]) - steps[-1]["contribution"]) < 1e-12
    values = customer_features(linear, "id", 3, FEATURES, n=2).collect()
    assert len(values) == 2 and abs(values[0]["contribution"]) >= abs(values[1]["contribution"])
    assert [r["feature"] for r in global_importance(linear, n=2).collect()] == ["a", "b"]
    extreme = {r["kind"]: r["total"] for r in extreme_customers(linear, "id", "y").collect()}
    assert extreme["high_risk"] > extreme["low_risk"]
    none = {r["kind"]: r["id"] for r in extreme_customers(linear.where("y = 0"), "id", "y").collect()}
    assert none["high_risk"] is None
