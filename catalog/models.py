"""Weights, training, scoring, evaluation and attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    DIGITS, KEY, LABEL, WEIGHTS, boosted, coefficients, explained, features, logistic, once,
    prepared, scored, scored_twice, test_side, training_side, tuned,
)
from catalog.figures import rounded
from catalog.registry import query
from catalog.sql import scaled_round, sql
from catalog.tables import metrics_sql
from keepline.functions.numbers import round_scaled
from keepline.operators.decide import contract_from_one_hot
from keepline.operators.evaluate import (
    class_report, confusion_matrix, evaluate, roc_auc, roc_comparison, roc_curve, with_prediction,
)
from keepline.operators.explain import (
    contribution_grid, dependence, dependence_curve, explain, global_importance,
    risk_hint, total_contribution, waterfall,
)
from keepline.operators.score import linear_score, read_coefficients, score
from keepline.operators.train import (
    balanced_weights, coefficient_table, feature_names, importance_table, pos_weight_ratio,
    top_coefficients, top_importances,
)
from keepline.operators.tree_shap import node_table, sample_contributions, tree_contributions
from keepline.plans.decisions import flagged_decisions
from keepline.session import as_table


@query(
    "g01_balanced_weights",
    sql("SELECT customerID, Churn_Binary, CAST((SELECT count(*) FROM feat) AS DOUBLE) / (2 * n_c) AS weight FROM feat JOIN class_sizes ON y = Churn_Binary"),
)
def _(spark, sf):
    return balanced_weights(features(spark, sf).select(KEY, LABEL), LABEL)


@query(
    "g02_pos_weight",
    sql(
        "SELECT neg, pos, " + scaled_round("CAST(neg AS DOUBLE) / pos", 2) + " AS ratio FROM "
        "(SELECT count(*) FILTER (Churn_Binary = 0) AS neg, count(*) FILTER (Churn_Binary = 1) AS pos FROM parted WHERE split = 'train')"
    ),
)
def _(spark, sf):
    return pos_weight_ratio(training_side(spark, sf), LABEL)


@query("g03_logistic_baseline")
def _(spark, sf):
    return coefficient_table(logistic(spark, sf), training_side(spark, sf))


@query(
    "g03_logistic_optimum",
    sql("SELECT count(*) AS n, CAST(true AS BOOLEAN) AS is_optimum FROM parted WHERE split = 'train'"),
)
def _(spark, sf):
    """At the fitted coefficients the gradient of the penalised likelihood vanishes."""
    names = prepared(spark, sf).scaled_names
    table = coefficient_table(logistic(spark, sf), training_side(spark, sf))
    weights, _ = read_coefficients(table)
    rows = linear_score(balanced_weights(training_side(spark, sf), LABEL), table)
    pull = F.col("weight") * (F.col("churn_prob") - F.col(LABEL))
    slopes = [F.sum(pull * F.col(f"`{c}`")) + F.lit(weights[c]) for c in names] + [F.sum(pull)]
    steepest = F.greatest(*[F.abs(s) for s in slopes]) / F.count(F.lit(1))
    return rows.agg(F.count(F.lit(1)).alias("n"), (steepest < 1e-4).alias("is_optimum"))


@query("g04_boosted_trees")
def _(spark, sf):
    return node_table(boosted(spark, sf), spark)


_ROOTS = "(SELECT count(*) AS n, sum(CASE WHEN Churn_Binary = 1 THEN w ELSE 1.0 END) AS weight, sum(CASE WHEN Churn_Binary = 1 THEN -w ELSE 1.0 END) / 2 AS gradient FROM parted, (SELECT " + scaled_round("CAST(count(*) FILTER (Churn_Binary = 0) AS DOUBLE) / count(*) FILTER (Churn_Binary = 1)", 2) + " AS w FROM parted WHERE split = 'train') WHERE split = 'train')"


@query(
    "g04_root_sums",
    sql(f"SELECT n, round(weight / 4, 4) AS cover, round(gradient, 4) AS gradient FROM {_ROOTS}"),
)
def _(spark, sf):
    """The first root has the rows, Hessians and gradients of the training side, where every margin is 0."""
    root = node_table(boosted(spark, sf), spark).where("treeID = 0 AND id = 0")
    return root.select("n", F.round("cover", 4).alias("cover"), F.round("gradient", 4).alias("gradient"))


@query("g04_node_sums", sql("SELECT t AS \"treeID\", true AS is_sound FROM (SELECT unnest(range(0, 100))::INTEGER AS t)"))
def _(spark, sf):
    """In every tree parents have the sums of their children, gains follow from them, and so do leaf values."""
    nodes = as_table(node_table(boosted(spark, sf), spark), "nodes")
    sides = [
        nodes.select("treeID", F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("gradient", "cover", "n")])
        for side in ("left", "right")
    ]
    rows = nodes.join(sides[0], ["treeID", "left"], "left").join(sides[1], ["treeID", "right"], "left")
    part = lambda p: F.col(f"{p}gradient") ** 2 / (F.col(f"{p}cover") + 1.0)
    gap = F.abs(part("left_") + part("right_") - part("") - F.col("gain"))
    sums = [F.abs(F.col(f"left_{c}") + F.col(f"right_{c}") - F.col(c)) < 1e-6 for c in ("gradient", "cover", "n")]
    inner = sums[0] & sums[1] & sums[2] & (gap < 1e-6 * (1 + F.col("gain"))) & (F.col("gain") > 0)
    leaf = F.abs(F.col("prediction") + 0.1 * F.col("gradient") / (F.col("cover") + 1.0)) < 1e-9
    return rows.groupBy("treeID").agg(F.every(F.when(F.col("left") >= 0, inner).otherwise(leaf)).alias("is_sound"))


@query("g05_grid_search")
def _(spark, sf):
    best, _ = tuned(spark, sf)
    out = score(best, test_side(spark, sf))
    return evaluate(out, "tuned", "churn_prob", LABEL)


@query("g06_score_models")
def _(spark, sf):
    """Both fitted models on the test side, one row per customer."""
    rows = score(logistic(spark, sf), test_side(spark, sf), "logistic_prob")
    return score(boosted(spark, sf), rows, "boosted_prob").select(KEY, LABEL, "logistic_prob", "boosted_prob")


@query(
    "g06_score_bounds",
    sql("SELECT count(*) AS n, count(*) AS n_valid FROM parted WHERE split = 'test'"),
)
def _(spark, sf):
    out = score(boosted(spark, sf), test_side(spark, sf))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("churn_prob").between(0, 1)).alias("n_valid"))


@query("g07_linear_score", sql("SELECT customerID, churn_prob FROM scored"))
def _(spark, sf):
    out = linear_score(features(spark, sf), coefficients(spark))
    return out.select(KEY, round_scaled(F.col("churn_prob"), DIGITS).alias("churn_prob"))


_PRED = "(SELECT Churn_Binary AS y, CASE WHEN churn_prob >= 0.5 THEN 1 ELSE 0 END AS p FROM scored)"


@query(
    "g08_confusion_matrix",
    sql(
        f"SELECT a AS actual, b AS predicted, (SELECT count(*) FROM {_PRED} WHERE y = a AND p = b) AS n "
        "FROM (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b)"
    ),
)
def _(spark, sf):
    return confusion_matrix(with_prediction(scored(spark, sf), "churn_prob"), LABEL)


@query("g09_metrics", sql(f"SELECT model, ordinal, metric, value FROM {metrics_sql('churn_prob', 'fixed')}"))
def _(spark, sf):
    return evaluate(scored(spark, sf), "fixed", "churn_prob", LABEL)


@query(
    "g10_roc_auc",
    sql(
        """SELECT round(sum(neg_g * (above + pos_g / 2.0::DOUBLE)) / sum(pos_g) / sum(neg_g), 9) AS roc_auc FROM (
        SELECT *, coalesce(CAST(sum(pos_g) OVER (ORDER BY churn_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0) AS above
        FROM (SELECT churn_prob, CAST(sum(Churn_Binary) AS DOUBLE) AS pos_g, CAST(sum(1 - Churn_Binary) AS DOUBLE) AS neg_g FROM scored GROUP BY 1))"""
    ),
)
def _(spark, sf):
    return rounded(roc_auc(scored(spark, sf), "churn_prob", LABEL), "roc_auc", digits=9)


def _curve_sql(prob: str) -> str:
    return (
        f"SELECT {prob} AS threshold, round(sum(neg_g) OVER w / (sum(neg_g) OVER ()), 9) AS fpr, round(sum(pos_g) OVER w / (sum(pos_g) OVER ()), 9) AS tpr "
        f"FROM (SELECT {prob}, CAST(sum(Churn_Binary) AS DOUBLE) AS pos_g, CAST(sum(1 - Churn_Binary) AS DOUBLE) AS neg_g FROM scored GROUP BY 1) "
        f"WINDOW w AS (ORDER BY {prob} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


@query("g11_roc_curve", sql(_curve_sql("churn_prob") + " UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE"))
def _(spark, sf):
    return rounded(roc_curve(scored(spark, sf), "churn_prob", LABEL), "fpr", "tpr", digits=9)


@query(
    "g11_roc_comparison",
    sql(
        f"SELECT 'new' AS model, * FROM ({_curve_sql('churn_prob')}) UNION ALL SELECT 'base', * FROM ({_curve_sql('other_prob')}) "
        "UNION ALL SELECT 'new', NULL, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT 'base', NULL, 0.0::DOUBLE, 0.0::DOUBLE "
        "UNION ALL SELECT 'random', NULL, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT 'random', NULL, 1.0::DOUBLE, 1.0::DOUBLE"
    ),
)
def _(spark, sf):
    curves = roc_comparison(scored_twice(spark, sf), {"new": "churn_prob", "base": "other_prob"}, LABEL)
    return rounded(curves, "fpr", "tpr", digits=9)


@query(
    "g12_class_report",
    sql(
        f""", c AS (SELECT CAST(count(*) FILTER (y = 0 AND p = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (y = 0 AND p = 1) AS DOUBLE) AS fp,
          CAST(count(*) FILTER (y = 1 AND p = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 1 AND p = 1) AS DOUBLE) AS tp FROM {_PRED}),
        m AS (SELECT 'No Churn' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f, tn + fp AS s FROM c
              UNION ALL SELECT 'Churn', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), fn + tp FROM c),
        a AS (SELECT * FROM m UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM m
              UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM m)
        SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, CAST(s AS BIGINT) AS support FROM a"""
    ),
)
def _(spark, sf):
    report = class_report(with_prediction(scored(spark, sf), "churn_prob"), LABEL)
    return rounded(report, "precision", "recall", "f1", digits=9)


@query("g13_coefficients")
def _(spark, sf):
    return top_coefficients(coefficient_table(logistic(spark, sf), training_side(spark, sf)))


@query("g14_feature_importance")
def _(spark, sf):
    return top_importances(importance_table(boosted(spark, sf), training_side(spark, sf)))


@query("g14_importance_gains", "SELECT count(*) AS n, count(*) AS n_equal FROM (SELECT unnest(range(0, 15)))")
def _(spark, sf):
    """The importances shown are the mean gains in the node table, as shares of all."""
    names = F.array(*[F.lit(n) for n in feature_names(boosted(spark, sf))])
    splits = node_table(boosted(spark, sf), spark).where("feature >= 0")
    gains = splits.groupBy(F.get(names, F.col("feature")).alias("feature")).agg(F.avg("gain").alias("gain"))
    whole = gains.agg(F.sum("gain").alias("whole"))
    shown = top_importances(importance_table(boosted(spark, sf), training_side(spark, sf)))
    rows = shown.join(gains, "feature", "left").withColumn("whole", whole.scalar())
    gap = F.abs(F.col("importance") - F.coalesce(F.col("gain"), F.lit(0.0)) / F.col("whole"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(gap < 1e-9).alias("n_equal"))


@query(
    "g14_importance_total",
    sql(
        "SELECT 25 + (SELECT count(DISTINCT gender) + count(DISTINCT InternetService) + count(DISTINCT Contract) + count(DISTINCT PaymentMethod) "
        "FROM parted WHERE split = 'train') AS n, 1.0::DOUBLE AS total"
    ),
)
def _(spark, sf):
    table = importance_table(boosted(spark, sf), training_side(spark, sf))
    return table.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("importance"), 9).alias("total"))


@query("g15_tuning_table")
def _(spark, sf):
    return tuned(spark, sf)[1]


_GRID = "(SELECT unnest([100, 200]) AS t), (SELECT unnest([3, 5]) AS d), (SELECT unnest(['0.05', '0.1']) AS r), (SELECT unnest(['0.8', '1.0']) AS s), (SELECT unnest(['0.8', '1.0']) AS c)"


@query("g15_tuning_grid", f"SELECT 'columns=' || c || ', depth=' || d || ', rate=' || r || ', rows=' || s || ', trees=' || t AS params, true AS is_score FROM {_GRID}")
def _(spark, sf):
    """Every combination of the grid has a mean F1, and the first is the best."""
    found = tuned(spark, sf)[1]
    best = found.agg(F.max("f1").alias("best")).scalar()
    right = F.col("f1").between(0, 1) & (F.col("is_best") <= (F.col("f1") == best))
    return found.select("params", right.alias("is_score"))


# ---- attribution ----------------------------------------------------------------------------


def attributed(spark, sf):
    """Tree contributions of the whole test side, with the model's own probability."""

    def make():
        model = boosted(spark, sf)
        names = feature_names(model)
        rows = score(model, test_side(spark, sf)).select(KEY, LABEL, "churn_prob", *[F.col(f"`{n}`") for n in names])
        return as_table(tree_contributions(rows, model), "attributed")

    return once(spark, sf, "attributed", make)


@query("h01_tree_contributions")
def _(spark, sf):
    return attributed(spark, sf).select(
        KEY, "churn_prob", "base_value", F.explode(F.map_from_entries("contributions")).alias("feature", "contribution")
    )


@query(
    "h01_tree_additivity",
    sql("SELECT count(*) AS n, count(*) AS n_additive FROM parted WHERE split = 'test'"),
)
def _(spark, sf):
    """Base value plus contributions gives back the model's log-odds, for every row."""
    p = F.col("churn_prob")
    gap = F.abs(F.col("base_value") + total_contribution(F.col("contributions")) - F.log(p / (1 - p)))
    return attributed(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(gap < 1e-9).alias("n_additive"))


@query(
    "h02_linear_contributions",
    sql("SELECT customerID, base_value, " + ", ".join(f"contributions[{i + 1}].c AS c_{f}" for i, f in enumerate(WEIGHTS)) + " FROM explained"),
)
def _(spark, sf):
    arr = F.col("contributions")
    return explained(spark, sf).select(
        KEY, "base_value", *[F.get(arr, F.lit(i))["contribution"].alias(f"c_{f}") for i, f in enumerate(WEIGHTS)]
    )


@query(
    "h03_global_importance",
    sql("SELECT feature, ordinal + 1 AS ordinal, round(avg(abs(contribution)), 9) AS mean_abs FROM long GROUP BY feature, ordinal ORDER BY avg(abs(contribution)) DESC LIMIT 15"),
)
def _(spark, sf):
    return rounded(global_importance(explained(spark, sf)), "mean_abs", digits=9)


_VALUES = ", ".join(f"{{'f': '{f}', 'x': CAST({f} AS DOUBLE), 'y': contributions[{i + 1}].c}}" for i, f in enumerate(WEIGHTS))


def _cell(v: str, lo: str, hi: str, bins: int) -> str:
    return f"CAST(CASE WHEN {hi} - {lo} = 0 THEN 0 ELSE least(floor(({v} - {lo}) / (({hi} - {lo}) / {bins})), {bins - 1}) END AS INTEGER)"


@query(
    "h04_contribution_grid",
    sql(
        f""", v AS (SELECT u.f AS feature, u.x AS x, u.y AS y FROM (SELECT unnest([{_VALUES}]) AS u FROM explained)),
        r AS (SELECT feature, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY feature)
        SELECT feature, {_cell('x', 'x0', 'x1', 10)} AS value_bin, {_cell('y', 'y0', 'y1', 20)} AS contribution_bin, count(*) AS n
        FROM v JOIN r USING (feature) GROUP BY 1, 2, 3"""
    ),
)
def _(spark, sf):
    return contribution_grid(explained(spark, sf), list(WEIGHTS))


@query(
    "h05_waterfall",
    sql(
        """, one AS (SELECT * FROM topped WHERE customerID = '7|1998-04-01'),
        s AS (SELECT customerID, unnest(range(1, 9)) AS step, unnest(biggest) AS b FROM one),
        t AS (SELECT list_sum(list_transform(contributions, lambda x: x.c)) AS total FROM one)
        SELECT customerID, CAST(step AS INTEGER) AS step, b.f AS feature, round(b.c, 6) AS contribution FROM s
        UNION ALL SELECT customerID, 0, '(base)', base_value FROM one
        UNION ALL SELECT customerID, 9, '(other)', 0.0::DOUBLE FROM one
        UNION ALL SELECT customerID, 10, '(margin)', round(base_value + total, 6) FROM one, t"""
    ),
)
def _(spark, sf):
    return rounded(waterfall(explained(spark, sf), KEY, "7|1998-04-01"), "contribution")


_TENURE = list(WEIGHTS).index("tenure") + 1


@query("h06_dependence", sql(f"SELECT tenure AS value, contributions[{_TENURE}].c AS contribution, MonthlyCharges AS color FROM explained"))
def _(spark, sf):
    return dependence(explained(spark, sf), "tenure", "MonthlyCharges")


@query(
    "h06_dependence_curve",
    sql(
        f"SELECT CAST(floor(tenure / 3.0::DOUBLE) AS INTEGER) AS bin, count(*) AS n, round(avg(contributions[{_TENURE}].c), 8) AS avg_contribution, "
        "round(avg(MonthlyCharges), 8) AS avg_color FROM explained GROUP BY 1"
    ),
)
def _(spark, sf):
    curve = dependence_curve(dependence(explained(spark, sf), "tenure", "MonthlyCharges"), 3.0)
    return rounded(curve, "avg_contribution", "avg_color", digits=8)


@query(
    "h07_explain",
    sql(
        "SELECT customerID, f1 || '|' || f2 || '|' || f3 AS features, l1 || '|' || l2 || '|' || l3 AS reasons, v1, v2, v3, "
        "top[5].c AS fifth, bottom[1].c AS lowest, contributions[1].c AS score_is_monthly FROM reasons"
    ),
)
def _(spark, sf):
    top = F.col("top_reasons")
    out = explain(explained(spark, sf))
    return out.select(
        KEY,
        F.array_join(top["feature"], "|").alias("features"),
        F.array_join(top["reason"], "|").alias("reasons"),
        *[F.get(top, F.lit(i))["shap_value"].alias(f"v{i + 1}") for i in range(3)],
        F.get(F.map_values("top_positive"), F.lit(4)).alias("fifth"),
        F.get(F.map_values("top_negative"), F.lit(0)).alias("lowest"),
        F.col("shap_scores")["is_monthly"].alias("score_is_monthly"),
    )


@query(
    "h08_risk_hint",
    sql(
        f"SELECT customerID, CASE WHEN contributions[{list(WEIGHTS).index('no_security') + 1}].c > 0 THEN 'support_issue' ELSE 'disengagement' END AS risk_hint FROM explained"
    ),
)
def _(spark, sf):
    return explained(spark, sf).select(KEY, risk_hint(F.col("contributions")).alias("risk_hint"))


@query("h09_sample_importance")
def _(spark, sf):
    return global_importance(sample_contributions(test_side(spark, sf), boosted(spark, sf), KEY))


# ---- values that SQL can check where the model itself is beyond it ---------------------------

_TEST_ROWS = "FROM parted WHERE split = 'test'"


@query("g13_coefficients_score", sql(f"SELECT count(*) AS n, count(*) AS n_equal {_TEST_ROWS}"))
def _(spark, sf):
    """The coefficient table gives every customer the score that the fitted model gives."""
    table = coefficient_table(logistic(spark, sf), training_side(spark, sf))
    rows = score(logistic(spark, sf), test_side(spark, sf)).withColumnRenamed("churn_prob", "by_model")
    gap = F.abs(F.col("by_model") - F.col("churn_prob"))
    return linear_score(rows, table).agg(F.count(F.lit(1)).alias("n"), F.count_if(gap < 1e-9).alias("n_equal"))


@query(
    "h01_contribution_counts",
    sql(
        "SELECT customerID, 25 + (SELECT count(DISTINCT gender) + count(DISTINCT InternetService) + count(DISTINCT Contract) "
        f"+ count(DISTINCT PaymentMethod) FROM parted WHERE split = 'train') AS n {_TEST_ROWS}"
    ),
)
def _(spark, sf):
    """Every test customer has a contribution for every feature."""
    return attributed(spark, sf).select(KEY, F.size("contributions").cast("long").alias("n"))


@query("h09_sample_keys", sql(f"SELECT customerID {_TEST_ROWS} ORDER BY customerID LIMIT 200"))
def _(spark, sf):
    return sample_contributions(test_side(spark, sf), boosted(spark, sf), KEY).select(KEY)


def trained_decisions(spark, sf):
    """Test customers scored by the boosted trees, those at risk explained by them and decided."""
    contract = contract_from_one_hot(F.col("`Contract_Two year`"), F.col("`Contract_One year`"))
    names = feature_names(boosted(spark, sf))
    rows = test_side(spark, sf).select(KEY, *[F.col(f"`{n}`") for n in names])
    scored = score(boosted(spark, sf), rows).withColumn("contract_type", contract)
    return scored, flagged_decisions(
        scored, KEY, attribute=lambda flagged: tree_contributions(flagged, boosted(spark, sf))
    )


@query("i14_trained_decisions")
def _(spark, sf):
    return trained_decisions(spark, sf)[1].select(
        KEY, "churn_prob", "risk_type", "eligible", "discount_pct", "strategy", "ltv", F.col("reasons")[0].alias("reason")
    )


@query("i14_trained_rules", sql(f"SELECT count(*) AS n, true AS all_flagged_decided, true AS offers_follow_rules {_TEST_ROWS}"))
def _(spark, sf):
    """Decisions on the trained model: every flagged customer has one, and offers keep the rules."""
    scored, decided = trained_decisions(spark, sf)
    p, value = F.col("churn_prob"), F.col("tenure") * F.col("MonthlyCharges")
    barred = (F.col("tenure") < 3) | (F.col("MonthlyCharges") < 30) | (F.col("contract_type") == "Two year")
    pct = (
        F.when(barred, 0)
        .when((p >= 0.80) & (value >= 500), 10)
        .when((p >= 0.80) & (value >= 100), 8)
        .when((p >= 0.65) & (value >= 500), 5)
        .otherwise(0)
    )
    kept = decided.agg(
        F.count(F.lit(1)).alias("n_decided"),
        F.count_if((F.col("discount_pct") == pct) & (F.col("eligible") == (pct > 0))).alias("n_right"),
    )
    whole = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(p >= 0.65).alias("n_flagged"))
    return whole.select(
        "n",
        (F.col("n_flagged") == kept.select("n_decided").scalar()).alias("all_flagged_decided"),
        (kept.select("n_decided").scalar() == kept.select("n_right").scalar()).alias("offers_follow_rules"),
    )
