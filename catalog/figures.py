"""Aggregates, top-k and arg-max queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    DIGITS, KEY, LABEL, WEIGHTS, coefficients, explained, features, outcomes, prepared, scored, snapshots,
)
from catalog.columns import RISK, risk
from catalog.registry import query
from catalog.sql import FITTED, WIDE, sql
from catalog.tables import COMPARED, both_metrics, records
from keepline.operators.eda import (
    correlation, histogram, mean_by_class, overview, point_cloud, point_density, rate_by, top_level,
)
from keepline.operators.evaluate import compare_models
from keepline.operators.explain import (
    bottom_contributions, extreme_customers, global_importance, largest_contributions,
    representative_customers, top_contributions,
)
from keepline.operators.profile import class_counts
from keepline.operators.scale import fit_scaler
from keepline.operators.train import top_coefficients
from keepline.plans.marts import (
    first_flagged, kpis, latest_messages, ordered, risk_level_distribution, risk_type_breakdown,
    run_summary, score_histogram, score_summary,
)
from keepline.sources.panel import panel_from


def rounded(df, *cols, digits: int = DIGITS):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("e00_snapshot_panel", sql("SELECT * FROM panel"))
def _(spark, sf):
    return panel_from(spark, sf)


@query(
    "e01_class_counts",
    sql("SELECT Churn, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM panel), 9) AS share FROM panel GROUP BY Churn"),
)
def _(spark, sf):
    return rounded(class_counts(snapshots(spark, sf), "Churn"), "share", digits=9)


_RATED = ["Contract", "InternetService", "PaymentMethod"]


@query(
    "e02_rate_by",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {c} AS level, count(*) AS n, round(avg(Churn_Binary), 9) AS rate FROM feat GROUP BY {c}" for c in _RATED
        )
        + " UNION ALL SELECT '(all)', '(all)', count(*), round(avg(Churn_Binary), 9) FROM feat"
    ),
)
def _(spark, sf):
    return rounded(rate_by(features(spark, sf), _RATED, LABEL), "rate", digits=9)


@query("e03_mean_tenure", sql("SELECT Churn, round(avg(tenure), 9) AS avg_tenure FROM panel GROUP BY Churn"))
def _(spark, sf):
    return rounded(mean_by_class(snapshots(spark, sf), "Churn", "tenure"), "avg_tenure", digits=9)


@query(
    "e04_top_contract",
    sql("SELECT Contract, round(avg(Churn_Binary), 9) AS rate FROM feat GROUP BY Contract ORDER BY avg(Churn_Binary) DESC, Contract LIMIT 1"),
)
def _(spark, sf):
    return rounded(top_level(features(spark, sf), "Contract", LABEL), "rate", digits=9)


@query("e05_overview", sql("SELECT count(*) AS n_rows, 19 AS n_inputs, round(avg(Churn_Binary), 9) AS positive_rate FROM feat"))
def _(spark, sf):
    return rounded(overview(features(spark, sf), LABEL, 19), "positive_rate", digits=9)


def _histogram_sql(col: str, table: str, by: str | None, last: str) -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN r USING ({by})" if by else ", r"
    return (
        f", r AS (SELECT {keys} min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi, count(*) AS total FROM {table} {group}), "
        f"w AS (SELECT {keys} lo, (hi - lo) / 30 AS width, total, "
        f"CAST(least(floor(({col} - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin FROM {table} {join}) "
        f"SELECT {keys} bin, round(lo + bin * width, {DIGITS}) AS bin_start, count(*) AS n, "
        f"round(CAST(count(*) AS DOUBLE) / ({last}), 9) AS {'density' if 'width' in last else 'share'} "
        f"FROM w GROUP BY {keys} bin, lo, width, total"
    )


def _histogram(name: str, col: str):
    @query(name, sql(_histogram_sql(col, "feat", "Churn", "total * width")))
    def _(spark, sf):
        out = histogram(features(spark, sf), col, "Churn")
        return rounded(rounded(out, "bin_start"), "density", digits=9)


_histogram("e06_histogram_tenure", "tenure")
_histogram("e06_histogram_monthly", "MonthlyCharges")
_histogram("e06_histogram_total", "TotalCharges")


@query("e06_score_histogram", sql(_histogram_sql("risk_score_pct", "risk", None, "total")))
def _(spark, sf):
    return rounded(rounded(score_histogram(risk(spark, sf)), "bin_start"), "share", digits=9)


_CORR = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", LABEL]


@query(
    "e07_correlation",
    sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS row_name, '{b}' AS col_name, round(corr({a}, {b}), 8) AS corr FROM feat"
            for i, a in enumerate(_CORR) for b in _CORR[:i]
        )
    ),
)
def _(spark, sf):
    return rounded(correlation(features(spark, sf), _CORR), "corr", digits=8)


_ALL = [*WIDE, LABEL]


@query(
    "e07_wide_correlation",
    sql(
        FITTED + "SELECT u.a AS row_name, u.b AS col_name, round(u.c, 8) AS corr FROM (SELECT unnest(["
        + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'c': corr(\"{a}\", \"{b}\")}}" for i, a in enumerate(_ALL) for b in _ALL[:i])
        + "]) AS u FROM wide)"
    ),
)
def _(spark, sf):
    """All features and the label, every pair."""
    return rounded(correlation(prepared(spark, sf).features, _ALL), "corr", digits=8)


@query("e08_point_cloud", sql("SELECT Churn, tenure, MonthlyCharges FROM panel"))
def _(spark, sf):
    return point_cloud(snapshots(spark, sf), "tenure", "MonthlyCharges", "Churn")


@query(
    "e08_point_density",
    sql(
        "SELECT Churn, CAST(floor(tenure / 6.0::DOUBLE) AS INTEGER) AS x_bin, CAST(floor(MonthlyCharges / 10.0::DOUBLE) AS INTEGER) AS y_bin, "
        "count(*) AS n FROM panel GROUP BY 1, 2, 3"
    ),
)
def _(spark, sf):
    return point_density(snapshots(spark, sf), "tenure", "MonthlyCharges", "Churn", 6.0, 10.0)


@query(
    "e09_score_summary",
    sql(
        "SELECT count(*) AS n, count(*) FILTER (churn_prob >= 0.65) AS n_flagged, round(avg(CASE WHEN churn_prob >= 0.65 THEN 1 ELSE 0 END), 9) AS share_flagged, "
        "round(avg(churn_prob), 9) AS mean_prob, max(churn_prob) AS max_prob FROM scored"
    ),
)
def _(spark, sf):
    return rounded(score_summary(scored(spark, sf)), "share_flagged", "mean_prob", digits=9)


@query(
    "e10_run_summary",
    sql(
        "SELECT count(*) AS processed, count(*) FILTER (action <> 'no_action') AS flagged, count(*) FILTER (action = 'no_action') AS skipped, "
        "count(*) FILTER (action = 'email_sent') AS messages, count(*) FILTER (action = 'pending') AS pending, "
        "count(*) FILTER (eligible) AS eligible, (SELECT round(avg(churn_prob), 9) FROM scored) AS mean_prob FROM outcomes"
    ),
)
def _(spark, sf):
    return rounded(run_summary(outcomes(spark, sf), scored(spark, sf)), "mean_prob", digits=9)


@query(
    "e11_risk_type_breakdown",
    sql(
        "SELECT k.risk_type, count(o.user_id) AS n, round(CAST(count(o.user_id) AS DOUBLE) / greatest((SELECT count(*) FROM outcomes WHERE action <> 'no_action'), 1) * 100, 9) AS pct_of_flagged "
        "FROM (SELECT unnest(['disengagement', 'support_issue']) AS risk_type) k LEFT JOIN outcomes o ON o.risk_type = k.risk_type GROUP BY k.risk_type"
    ),
)
def _(spark, sf):
    return rounded(risk_type_breakdown(outcomes(spark, sf)), "pct_of_flagged", digits=9)


@query(
    "e12_kpis",
    sql(
        "SELECT count(*) AS users, count(*) FILTER (flagged = 1) AS flagged, count(*) FILTER (churn_prob >= 0.8) AS high_risk, "
        "round(avg(true_label), 9) AS churn_rate, (SELECT count(*) FROM outcomes WHERE action = 'email_sent') AS messages, "
        "(SELECT count(*) FROM outcomes WHERE action = 'email_sent' AND eligible) AS discounts FROM risk"
    ),
)
def _(spark, sf):
    return rounded(kpis(risk(spark, sf), records(spark, sf)), "churn_rate", digits=9)


@query("e13_risk_levels", sql("SELECT risk_level, count(*) AS n FROM risk GROUP BY risk_level"))
def _(spark, sf):
    return risk_level_distribution(risk(spark, sf))


@query(
    "e14_compare_models",
    sql(f"SELECT ordinal, metric, base, new, round(delta, 6) AS delta_pp, CASE WHEN delta > 0 THEN '↑' ELSE '↓' END AS direction FROM {COMPARED}"),
)
def _(spark, sf):
    return rounded(compare_models(both_metrics(spark, sf), "base", "new"), "delta_pp")


# ---- order, top-k, arg-max ------------------------------------------------------------------


@query("f01_order_by_risk", sql(f"SELECT {RISK} FROM risk"))
def _(spark, sf):
    return ordered(risk(spark, sf), KEY)


_STD = ", ".join(f"stddev_pop(CAST({f} AS DOUBLE)) AS s_{f}" for f in WEIGHTS)


@query(
    "f02_top_coefficients",
    sql(
        f", s AS (SELECT {_STD} FROM feat) SELECT feature, ordinal, round(weight, {DIGITS}) AS weight FROM (SELECT u.f AS feature, u.o AS ordinal, u.w AS weight FROM (SELECT unnest(["
        + ", ".join(f"{{'f': '{f}', 'o': {i + 1}, 'w': CAST({w} AS DOUBLE) * s_{f}}}" for i, (f, w) in enumerate(WEIGHTS.items()))
        + "]) AS u FROM s)) ORDER BY abs(weight) DESC LIMIT 15"
    ),
)
def _(spark, sf):
    """Coefficients on the scale of standardised features, the fifteen largest."""
    spread = fit_scaler(features(spark, sf), list(WEIGHTS)).select("feature", "scale")
    table = coefficients(spark).join(spread, "feature").select(
        "feature", "ordinal", (F.col("weight") * F.col("scale")).alias("weight")
    )
    return rounded(top_coefficients(table, 15), "weight")


@query(
    "f03_top_contributions",
    sql(f"SELECT feature, ordinal + 1 AS ordinal, round(avg(abs(contribution)), 9) AS mean_abs FROM long GROUP BY feature, ordinal ORDER BY avg(abs(contribution)) DESC LIMIT 15"),
)
def _(spark, sf):
    return rounded(global_importance(explained(spark, sf)), "mean_abs", digits=9)


@query(
    "f04_first_flagged",
    sql(
        "SELECT user_id, format('{:.1f}', churn_prob * 100.0::DOUBLE) || '%' AS churn_prob_text, risk_type, discount_pct || '%' AS discount, "
        "substring(email_subject, 1, 40) AS subject FROM outcomes WHERE action <> 'no_action' ORDER BY user_id LIMIT 20"
    ),
)
def _(spark, sf):
    return first_flagged(outcomes(spark, sf), 20)


@query(
    "f04_latest_messages",
    sql(
        "SELECT customerID AS user_id, strftime(as_of, '%Y-%m-%dT00:00:00') AS timestamp, risk_type FROM decided WHERE PaperlessBilling = 'Yes' ORDER BY as_of DESC, customerID DESC LIMIT 5"
    ),
)
def _(spark, sf):
    return latest_messages(records(spark, sf)).select("user_id", "timestamp", "risk_type")


def _names(column):
    return F.array_join(column["feature"], ",")


def _sql_names(column: str, n: int) -> str:
    return f"array_to_string(list_transform({column}[1:{n}], lambda x: x.f), ',')"


@query(
    "f05_top_and_bottom",
    sql(f"SELECT customerID, {_sql_names('top', 5)} AS top5, {_sql_names('top', 3)} AS top3, {_sql_names('bottom', 3)} AS bottom3 FROM topped"),
)
def _(spark, sf):
    arr = F.col("contributions")
    best = explained(spark, sf).select(
        KEY, top_contributions(arr, 5).alias("top"), bottom_contributions(arr, 3).alias("bottom")
    )
    return best.select(
        KEY,
        _names(F.col("top")).alias("top5"),
        _names(F.slice("top", 1, 3)).alias("top3"),
        _names(F.col("bottom")).alias("bottom3"),
    )


@query("f06_largest", sql(f"SELECT customerID, {_sql_names('biggest', 12)} AS features FROM topped"))
def _(spark, sf):
    return explained(spark, sf).select(KEY, _names(largest_contributions(F.col("contributions"), 12)).alias("features"))


@query(
    "f07_extreme_customers",
    sql(
        ", t AS (SELECT customerID, Churn_Binary, round(list_sum(list_transform(contributions, lambda x: x.c)), 6) AS total FROM explained) "
        "SELECT * FROM (SELECT 'high_risk' AS kind, customerID, total FROM t WHERE Churn_Binary = 1 ORDER BY total DESC, customerID LIMIT 1) "
        "UNION ALL SELECT * FROM (SELECT 'low_risk', customerID, total FROM t WHERE Churn_Binary = 0 ORDER BY total, customerID LIMIT 1)"
    ),
)
def _(spark, sf):
    return rounded(extreme_customers(explained(spark, sf), KEY, LABEL), "total")


@query(
    "f08_representative_customers",
    sql(
        "SELECT * FROM (SELECT 'high' AS kind, customerID, churn_prob FROM scored WHERE Churn_Binary = 1 ORDER BY churn_prob DESC, customerID LIMIT 1) "
        "UNION ALL SELECT * FROM (SELECT 'low', customerID, churn_prob FROM scored ORDER BY churn_prob, customerID LIMIT 1) "
        "UNION ALL SELECT * FROM (SELECT 'mid', customerID, churn_prob FROM scored WHERE Churn_Binary = 1 ORDER BY abs(churn_prob - 0.70::DOUBLE), customerID LIMIT 1)"
    ),
)
def _(spark, sf):
    return representative_customers(scored(spark, sf), KEY, LABEL, "churn_prob")
