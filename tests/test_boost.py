from __future__ import annotations

import numpy as np
import pytest
from planted import planted
from pyspark.sql import functions as F
from test_explain import brute_shapley

from keepline.operators import boost
from keepline.operators.score import score
from keepline.operators.split import stratified_folds
from keepline.operators.train import feature_names, importance_table, pos_weight
from keepline.operators.tree_shap import tree_contributions
from keepline.plans.preprocess import preprocess

FEATURES = ["a", "b", "c d"]


@pytest.fixture(scope="module")
def rows(spark):
    """Values with many ties, weights, and a label that depends on two of the features."""
    draw = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(f"{i}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return spark.range(0, 400, 1, 5).select(
        "id", F.round(draw(1) * 9).alias("a"), draw(2).alias("b"), F.floor(draw(3) * 2).cast("int").alias("c d"),
        (draw(4) < 0.2 + 0.5 * (draw(2) > 0.6).cast("int") * (F.round(draw(1) * 9) > 3).cast("int")).cast("int").alias("y"),
        (1 + F.floor(draw(5) * 3)).cast("double").alias("weight"),
    ).cache()


def brute(x, y, w, edges, p, columns, used):
    """Leaf value per row and all (gain, feature, threshold) of each tree, by trying every cut of every node."""
    margin, gains = np.zeros(len(x)), []
    for t in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = w * (prob - y), w * prob * (1 - prob)
        found, value = [], np.zeros(len(x))

        def visit(rows, depth, g=g, h=h, found=found, value=value, t=t):
            use = rows & used[t]
            part = lambda m: g[m].sum() ** 2 / (h[m].sum() + p.l2)
            best = None
            for f in columns[t] if depth < p.depth else ():
                for e in edges[f]:
                    left, right = use & (x[:, f] <= e), use & (x[:, f] > e)
                    if left.any() and right.any() and min(h[left].sum(), h[right].sum()) >= p.least:
                        gain = part(left) + part(right) - part(use)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, f, e)
            if best is None:
                value[rows] = -p.rate * g[use].sum() / (h[use].sum() + p.l2)
                return
            found.append(best)
            visit(rows & (x[:, best[1]] <= best[2]), depth + 1)
            visit(rows & (x[:, best[1]] > best[2]), depth + 1)

        visit(np.ones(len(x), dtype=bool), 0)
        gains.append(sorted(found))
        margin = margin + value
    return margin, gains


@pytest.mark.parametrize("in_task", [0, 10_000])
@pytest.mark.parametrize("share,columns", [(1.0, 1.0), (0.7, 0.7)])
def test_trees_equal_brute_force(spark, rows, in_task, share, columns):
    p = boost.TreeParams(trees=3, depth=3, rate=0.3, rows=share, columns=columns, least=2.0)
    edges = boost.bin_edges(rows, FEATURES, 16)
    table = boost.binned_rows(rows, FEATURES, "y", "weight", edges, "id")
    model = boost.fit_on(table, FEATURES, edges, p, in_task)
    data = rows.orderBy("id").toPandas()
    row = dict((r["id"], r["row"]) for r in table.select("id", "row").collect())
    number = np.array([row[i] for i in data["id"]])
    used = [boost.drawn(number, t, share, p.seed) if share < 1 else np.ones(len(data), dtype=bool) for t in range(p.trees)]
    drawn = [np.flatnonzero(boost.columns_of(t, 3, columns, p.seed)) for t in range(p.trees)]
    x = data[FEATURES].to_numpy(dtype=float)
    margin, gains = brute(x, data["y"].to_numpy(), data["weight"].to_numpy(), edges, p, drawn, used)
    got = score(model, rows).orderBy("id").select("churn_prob").toPandas()["churn_prob"].to_numpy()
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-margin)), rtol=1e-10)
    for tree, want in zip(model.trees, gains):
        inner = np.flatnonzero(tree.feature >= 0)
        have = sorted((tree.gain[i], tree.feature[i], edges[tree.feature[i]][tree.split[i]]) for i in inner)
        np.testing.assert_allclose(have, want, rtol=1e-9)
    assert sum(map(len, gains)) > 8
    if share < 1:
        assert 0.6 < np.mean(used) < 0.8 and all(len(c) == 2 for c in drawn)


def test_margins_are_settled_between_trees(spark, rows, monkeypatch):
    """Jobs over all rows give the trees of one task, with margins written on the way."""
    monkeypatch.setattr(boost, "SETTLED", 2)
    some = dict(trees=5, depth=2, rate=0.2, bins=16)
    far = boost.fit_trees(rows, FEATURES, "y", in_task=0, **some)
    near = boost.fit_trees(rows, FEATURES, "y", **some)
    for a, b in zip(far.trees, near.trees):
        assert a.feature.tolist() == b.feature.tolist() and a.split.tolist() == b.split.tolist()
        np.testing.assert_allclose(a.value, b.value, rtol=1e-9)


def test_prefix_of_a_model_is_the_smaller_model(rows):
    some = dict(depth=3, rate=0.2, rows=0.8, columns=0.7)
    large, small = (boost.fit_trees(rows, FEATURES, "y", trees=n, **some) for n in (9, 4))
    for a, b in zip(large.trees[:4], small.trees, strict=True):
        assert all(np.array_equal(u, v) for u, v in zip(a, b))


def test_search_scores_each_setting_as_fitted_alone(spark, rows):
    folded = stratified_folds(rows, "id", "y", 3)
    grid = {"trees": (2, 6), "depth": (1, 3), "rate": (0.3,)}
    best, found = boost.tune_trees(folded, FEATURES, "y", "fold", grid, sample=10_000)
    table = {r["params"]: r["f1"] for r in found.collect()}
    assert len(table) == 4 and found.first()["is_best"] and found.first()["f1"] == max(table.values())
    edges = boost.bin_edges(folded, FEATURES)
    for depth in (1, 3):
        for trees in (2, 6):
            scores = []
            for out in (r[0] for r in folded.select("fold").distinct().collect()):
                side = boost.binned_rows(folded.where(F.col("fold") != out), FEATURES, "y", "weight", edges)
                model = boost.fit_on(side, FEATURES, edges, boost.TreeParams(trees=trees, depth=depth, rate=0.3))
                got = score(model, folded.where(F.col("fold") == out)).select("y", (F.col("churn_prob") >= 0.5).cast("int").alias("p")).toPandas()
                tp = ((got.y == 1) & (got.p == 1)).sum()
                scores.append(2 * tp / max(1, 2 * tp + (got.y != got.p).sum()))
            assert table[f"depth={depth}, rate=0.3, trees={trees}"] == pytest.approx(np.mean(scores))
    n = 1
    for values in boost.GRID.values():
        n *= len(values)
    assert n == 32 and feature_names(best) == FEATURES


def many(spark, n=12_000):
    """More rows than the search once drew; a label that depends on two of the features."""
    bit = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000
    return spark.range(0, n, 1, 5).select(
        "id", F.round(bit(1) * 9).alias("a"), bit(2).alias("b"), F.floor(bit(3) * 2).cast("int").alias("c d"), F.lit(1.5).alias("weight"),
        (bit(4) < 0.3 + 0.3 * ((bit(2) > 0.6) & (F.round(bit(1) * 9) > 3)).cast("int")).cast("int").alias("y"),
    )


@pytest.mark.parametrize("apart", [True, False])
def test_search_fits_on_all_rows(spark, apart):
    """F1 of every setting is that of models of all rows of the other folds, each in a task or all growing together."""
    folded = stratified_folds(many(spark), "id", "y", 2).cache()
    some = {} if apart else {"in_task": 0}
    _, found = boost.tune_trees(folded, FEATURES, "y", "fold", {"trees": (4, 8), "depth": (4,), "rate": (0.3,)}, **some)
    table = {r["params"]: r["f1"] for r in found.collect()}
    edges = boost.bin_edges(folded, FEATURES)
    for trees in (4, 8):
        scores = []
        for out in (r[0] for r in folded.select("fold").distinct().collect()):
            side = boost.binned_rows(folded.where(F.col("fold") != out), FEATURES, "y", "weight", edges)
            model = boost.fit_on(side, FEATURES, edges, boost.TreeParams(trees=trees, depth=4, rate=0.3))
            assert model.trees[0].n[0] == folded.where(F.col("fold") != out).count()
            got = score(model, folded.where(F.col("fold") == out)).select("y", (F.col("churn_prob") >= 0.5).cast("int").alias("p")).toPandas()
            tp = ((got.y == 1) & (got.p == 1)).sum()
            scores.append(2 * tp / max(1, 2 * tp + (got.y != got.p).sum()))
        assert table[f"depth=4, rate=0.3, trees={trees}"] == pytest.approx(np.mean(scores), abs=1e-12)
    folded.unpersist()


def test_search_of_fits_apart_and_together(spark, rows, monkeypatch):
    """Fits that grow together, a few at once, are those of a task each, also where rows and columns are drawn."""
    monkeypatch.setattr(boost, "AT_ONCE", 5)
    monkeypatch.setattr(boost, "SEARCH_SETTLED", 2)
    monkeypatch.setattr(boost, "BLOCK", 60)
    folded = stratified_folds(rows, "id", "y", 3)
    edges = boost.bin_edges(folded, FEATURES, 16)
    table = boost.binned_rows(folded, FEATURES, "y", "weight", edges, "fold")
    sizes = boost._sizes(edges)
    fits = [(boost.TreeParams(trees=5, depth=d, rows=r, columns=0.7), out) for d in (1, 3) for r in (0.8, 1.0) for out in (0, 2)]
    apart, together = boost._fit_apart(table, sizes, fits, "fold"), boost._fit_together(table, sizes, fits, "fold")
    for a, b, (_, out) in zip(apart, together, fits, strict=True):
        assert len(a) == len(b) == 5 and a[0][7][0] <= table.where(F.col("fold") != out).count()
        for u, v in zip(a, b):
            assert np.array_equal(u[0], v[0]) and np.array_equal(u[1], v[1]) and np.array_equal(u[7], v[7])
            np.testing.assert_allclose(u[3], v[3], rtol=1e-9, atol=1e-12)
    grid = {"trees": (2, 5), "depth": (1, 3), "rows": (0.8,), "columns": (0.7, 1.0)}
    (_, one), (_, two) = (boost.tune_trees(folded, FEATURES, "y", "fold", grid, in_task=n) for n in (10_000, 0))
    assert one.count() == 8 and one.collect() == two.collect()


def test_joint_counts_of_features_of_any_bins():
    """Features of many and few bins counted by joint codes have the sums of each alone."""
    rng = np.random.default_rng(3)
    sizes = [64, 2, 64, 9, 1, 2, 33, 2]
    bins = np.column_stack([rng.integers(0, n, 3000) for n in sizes]).astype(np.uint8)
    joint = boost._joint(range(len(sizes)), sizes, boost.CELLS)
    assert sorted(f for g in joint for f in g) == list(range(len(sizes))) and len(joint) < 4
    at, g, h = rng.integers(0, 5, len(bins)), rng.normal(size=len(bins)), rng.random(len(bins))
    for keep in (None, rng.random(len(bins)) < 0.6):
        alone = boost.histograms(bins, at, g, h, [3, 1], 64, keep)
        np.testing.assert_allclose(boost.histograms(bins, at, g, h, [3, 1], 64, keep, joint, sizes), alone, atol=1e-10)


def test_search_of_one_fold_has_no_rows_to_learn_from(spark, rows):
    one = rows.withColumn("fold", F.lit(7))
    for n in (10_000, 0):
        best, found = boost.tune_trees(one, FEATURES, "y", "fold", {"trees": (2,), "depth": (2,)}, in_task=n)
        assert found.count() == 1 and len(best.trees) == 2


def test_sample_bounds_the_search(rows, monkeypatch):
    edges = boost.bin_edges(rows, FEATURES)
    table = boost.binned_rows(rows, FEATURES, "y", "weight", edges)
    assert 60 < len(boost._sampled(table, 100)) <= 110 and len(boost._sampled(table, 400)) == 400


def test_contributions_add_up(rows):
    model = boost.fit_trees(rows, FEATURES, "y", trees=4, depth=3, rate=0.3)
    explained = tree_contributions(score(model, rows), model)
    nodes = model.nodes(rows.sparkSession).collect()
    for r in explained.where("id < 8").collect():
        base, phi = brute_shapley(nodes, [r[f] for f in FEATURES])
        assert abs(r["base_value"] - base) < 1e-9
        np.testing.assert_allclose([c["contribution"] for c in r["contributions"]], phi, atol=1e-9)
        assert np.log(r["churn_prob"] / (1 - r["churn_prob"])) == pytest.approx(base + phi.sum(), abs=1e-9)


def test_saved_model_scores_alike(spark, rows, tmp_path):
    model = boost.fit_trees(rows, FEATURES, "y", trees=4, depth=3, rate=0.3)
    boost.save_trees(model, spark, str(tmp_path / "m"))
    loaded = boost.load_trees(spark, str(tmp_path / "m"))
    assert loaded.features == FEATURES and loaded.depth == model.depth
    both = score(loaded, score(model, rows, "one"), "two")
    assert both.where("one != two").count() == 0
    assert importance_table(loaded, rows).collect() == importance_table(model, rows).collect()


def test_odd_tables(spark, rows):
    with pytest.raises(ValueError):
        boost.fit_trees(rows.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), FEATURES, "y")
    with pytest.raises(ValueError):
        boost.fit_trees(rows.where("id < 0"), FEATURES, "y")
    same = rows.withColumns({f: F.lit(1.0) for f in FEATURES})
    flat = boost.fit_trees(same, FEATURES, "y", trees=2)
    assert all(len(t.feature) == 1 for t in flat.trees) and flat.depth == 0
    assert importance_table(flat, rows).agg(F.sum("importance")).first()[0] == 0
    assert score(flat, rows.where("id < 0")).count() == 0


def test_learns_the_planted_signal(spark):
    ready = preprocess(planted(spark))
    train = pos_weight(ready.features.where("split = 'train'"), "Churn_Binary")
    model = boost.fit_trees(train, ready.names, "Churn_Binary", trees=60, depth=3, rate=0.1)
    from test_train import auc

    assert auc(score(model, ready.features.where("split = 'test'"))) > 0.75


def test_all_rows_are_fitted_from_blocks_without_writing_them_again(spark, rows, monkeypatch):
    """Blocks of few rows in many partitions give the trees of one task; renewed margins cost no table."""
    names, edges = FEATURES, boost.bin_edges(rows, FEATURES, 16)
    table = boost.binned_rows(rows.repartition(5), names, "y", "weight", edges)
    params = boost.TreeParams(trees=5, depth=3, rows=0.8)
    alone = boost.fit_on(table, names, edges, params)
    monkeypatch.setattr(boost, "SETTLED", 2)
    monkeypatch.setattr(boost, "BLOCK", 1)
    monkeypatch.setattr(boost, "FEW_PARTS", 1)
    monkeypatch.setattr(boost, "as_table", lambda df, name: pytest.fail(f"{name} are written"))
    together = boost.fit_on(table, names, edges, params, in_task=0)
    for a, b in zip(alone.trees, together.trees, strict=True):
        assert a.n.tolist() == b.n.tolist() and np.allclose(a.value, b.value) and np.allclose(a.gain, b.gain)


@pytest.mark.parametrize("depth", [0, 1, 4, 9])
def test_paths_of_small_and_large_trees(depth):
    rng = np.random.default_rng(depth)
    bins = rng.integers(0, 256, (500, 3)).astype(np.uint8)
    feature, split, left = [-1], [0], [-1]
    for _ in range(150 if depth == 9 else 20):
        node = rng.choice(np.flatnonzero(np.array(feature) < 0))
        feature[node], split[node], left[node] = int(rng.integers(3)), int(rng.integers(256)), len(feature)
        feature, split, left = feature + [-1, -1], split + [0, 0], left + [-1, -1]
    tree = tuple(np.array(x) for x in (feature, split, left))
    want = []
    for row in bins:
        node = 0
        for _ in range(depth):
            if feature[node] >= 0:
                node = left[node] + int(row[feature[node]] > split[node])
        want.append(node)
    for order in "CF":
        assert boost.node_of(tree, np.array(bins, order=order), depth).tolist() == want


def test_features_of_two_bins_are_counted_together(spark, rows):
    """Bits counted by their joint code give the sums of each alone, and the trees those of one task."""
    bit = lambda i: (F.shiftright(F.xxhash64("id").cast("long"), i).bitwiseAND(F.lit(1))).cast("int")
    wide = rows.select("*", *[bit(i).alias(f"bit {i}") for i in range(11)], (-bit(3)).alias("copy"))
    names = [*FEATURES, *[f"bit {i}" for i in range(11)], "copy"]
    edges = boost.bin_edges(wide, names, 16)
    two = boost._two_bins(edges)
    assert len(two) == 13 and [len(g) for g in boost._joint(two)] == [8, 5]
    table = boost.binned_rows(wide, names, "y", "weight", edges)
    data = table.orderBy("row").toPandas()
    bins = np.array([list(b) for b in data["bins"]], dtype=np.uint8)
    x = wide.select("id", *[F.col(f"`{n}`") for n in names], F.monotonically_increasing_id().alias("row")).orderBy("row").toPandas()[names].to_numpy(dtype=float)
    assert np.array_equal(bins, boost.binned(x, edges))
    rng = np.random.default_rng(1)
    at, g, h = rng.integers(0, 5, len(bins)), rng.normal(size=len(bins)), rng.random(len(bins))
    for keep in (None, rng.random(len(bins)) < 0.6):
        alone, joint = (boost.histograms(bins, at, g, h, [3, 1], 16, keep, j) for j in ((), boost._joint(two)))
        np.testing.assert_allclose(joint, alone, atol=1e-12)
    for share in (1.0, 0.7):
        p = boost.TreeParams(trees=4, depth=3, rows=share)
        near, far = (boost.fit_on(table, names, edges, p, n) for n in (10_000, 0))
        for a, b in zip(near.trees, far.trees, strict=True):
            assert a.n.tolist() == b.n.tolist()
            np.testing.assert_allclose(a.value, b.value, rtol=1e-9)
            assert "copy" not in [names[f] for f in b.feature[b.feature >= 0]]


def test_blocks_hold_few_bytes(spark, rows):
    """Bits for features of two bins, labels in a byte, row numbers only where rows are drawn; other labels are kept."""
    edges = boost.bin_edges(rows, FEATURES, 16)
    for frame, drawn_rows, size in ((rows, False, 20), (rows, True, 28), (rows.withColumn("y", F.col("y") / 2), False, 27)):
        table = boost.binned_rows(frame, FEATURES, "y", "weight", edges)
        blocks = boost._blocks(table, 3, boost._two_bins(edges), drawn_rows)
        held, opened = blocks.collect(), boost._opened(3, boost._two_bins(edges))
        assert sum(len(part) for block in held for part in block) == size * 400
        back = [opened(block) for block in held]
        want = table.toPandas()
        assert sorted(np.concatenate([b[1] for b in back]).tolist()) == sorted(want["label"])
        assert sorted(bytes(r) for b in back for r in np.ascontiguousarray(b[4])) == sorted(bytes(r) for r in want["bins"])
        blocks.unpersist()


def test_two_values_need_no_sketch(rows, monkeypatch):
    """Two-valued features have the edge their quantiles give, also where one value is rarer than a bin."""
    rare = rows.select("a", (F.col("id") < 3).cast("int").alias("low"), (F.col("id") >= 3).cast("int").alias("high"), F.lit(7).alias("one"), (F.col("id") % 2).alias("even"))
    got = boost.bin_edges(rare, rare.columns, 16)
    assert [e.tolist() for e in got[1:]] == [[0.0], [], [], [0.0]]
    monkeypatch.setattr(boost, "_two_valued", lambda df, features: {})
    assert [e.tolist() for e in boost.bin_edges(rare, rare.columns, 16)] == [e.tolist() for e in got]
