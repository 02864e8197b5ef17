"""Cleaning, predicates, feature columns, encoding, splitting and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    DIGITS, KEY, LABEL, WEIGHTS, decisions, explained, features, prepared, scored, snapshots,
)
from catalog.registry import query
from catalog.sql import FITTED, LEVELS, RAW_WIDE, SCALED_WIDE, WIDE, case, fixed, number, sql, strip
from catalog.tables import COMPARED, both_metrics, records, whole_features
from keepline.functions.text import lookup
from keepline.operators.clean import (
    binary_target, coerce_numeric, drop_columns, drop_exact_duplicates, duplicate_counts,
    fit_medians, impute, impute_constant, latest_per_key, trim_strings,
)
from keepline.operators.decide import contract_from_one_hot, flag_at_risk, profile_for_decision, risk_level
from keepline.operators.encode import bools_to_int, fit_levels, map_binary, one_hot
from keepline.operators.evaluate import metrics_side_by_side
from keepline.operators.explain import customer_features
from keepline.operators.features import (
    active_services, charge_per_service, engineer, lifetime_value, recency_score, tenure_bucket,
)
from keepline.operators.profile import limit_users
from keepline.operators.scale import apply_scaler, fit_scaler
from keepline.operators.split import split_summary, stratified_folds, stratified_split
from keepline.plans.marts import (
    customer_detail, customer_join, display_id, filter_log, filter_risk, ordered, risk_table,
)
from keepline.roles import REASON_LABELS, ROUTING, STRATEGY_TEXT, TELCO

# ---- cleaning ---------------------------------------------------------------------------

_DIRTY = """CASE tenure % 6 WHEN 0 THEN TotalCharges WHEN 1 THEN chr(9) || TotalCharges || ' ' WHEN 2 THEN TotalCharges || 'd'
  WHEN 3 THEN 'abc' || TotalCharges WHEN 4 THEN trim(TotalCharges) || 'e1' ELSE '-' || trim(TotalCharges) END"""


@query("b01_coerce_numeric", sql(f"SELECT customerID, {number('dirty')} AS dirty FROM (SELECT customerID, {_DIRTY} AS dirty FROM panel)"))
def _(spark, sf):
    t, kind = F.col("TotalCharges"), F.col("tenure") % 6
    dirty = (
        F.when(kind == 0, t)
        .when(kind == 1, F.concat(F.lit("\t"), t, F.lit(" ")))
        .when(kind == 2, F.concat(t, F.lit("d")))
        .when(kind == 3, F.concat(F.lit("abc"), t))
        .when(kind == 4, F.concat(F.trim(t), F.lit("e1")))
        .otherwise(F.concat(F.lit("-"), F.trim(t)))
    )
    return coerce_numeric(snapshots(spark, sf).select(KEY, dirty.alias("dirty")), ["dirty"])


@query(
    "b02_impute_median",
    sql(
        f", v AS (SELECT customerID, {number('TotalCharges')} AS x FROM panel) "
        "SELECT customerID, round(coalesce(x, (SELECT median(x) FROM v)), 6) AS TotalCharges FROM v"
    ),
)
def _(spark, sf):
    rows = coerce_numeric(snapshots(spark, sf).select(KEY, "TotalCharges"), ["TotalCharges"])
    return impute(rows, fit_medians(rows, ["TotalCharges"])).withColumn("TotalCharges", F.round("TotalCharges", 6))


@query("b03_impute_constant", sql(f"SELECT customerID, coalesce({number('TotalCharges')}, 0.0::DOUBLE) AS TotalCharges FROM panel"))
def _(spark, sf):
    rows = coerce_numeric(snapshots(spark, sf).select(KEY, "TotalCharges"), ["TotalCharges"])
    return impute_constant(rows, ["TotalCharges"], 0.0)


@query("b04_binary_target", sql("SELECT customerID, Churn, Churn_Binary FROM feat"))
def _(spark, sf):
    return binary_target(snapshots(spark, sf).select(KEY, "Churn"), "Churn", "Yes", LABEL)


@query("b05_trim_strings", f"SELECT doc_id, {strip('text')} AS text, {strip('lang')} AS lang, {strip('source')} AS source FROM documents")
def _(spark, sf):
    return trim_strings(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source"))


_ATTRIBUTES = ["gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "InternetService", "Contract", "Churn"]


@query("b06_drop_duplicates", sql(f"SELECT DISTINCT {', '.join(_ATTRIBUTES)} FROM panel"))
def _(spark, sf):
    return drop_exact_duplicates(snapshots(spark, sf).select(*_ATTRIBUTES))


@query(
    "b06_latest_per_key",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER ("
    "PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS place FROM lineitem) WHERE place = 1",
)
def _(spark, sf):
    """Order lines, whose key repeats, with one row per key: the dearest."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"
    )
    return latest_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_extendedprice"])


@query(
    "b06_duplicate_counts",
    sql(
        f"SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n) - count(*) AS BIGINT) AS removed "
        f"FROM (SELECT count(*) AS n FROM panel GROUP BY {', '.join(_ATTRIBUTES)})"
    ),
)
def _(spark, sf):
    return duplicate_counts(snapshots(spark, sf).select(*_ATTRIBUTES))


@query("b07_drop_columns", sql("SELECT customerID, tenure, MonthlyCharges FROM panel"))
def _(spark, sf):
    rows = snapshots(spark, sf).select(KEY, "tenure", "MonthlyCharges", "Churn")
    return drop_columns(rows, ["Churn", "not_there"])


# ---- predicates and views -----------------------------------------------------------------


@query("b08_flag_at_risk", sql("SELECT customerID, churn_prob, CASE WHEN churn_prob >= 0.65 THEN 1 ELSE 0 END AS flagged FROM scored"))
def _(spark, sf):
    return flag_at_risk(scored(spark, sf)).select(KEY, "churn_prob", "flagged")


@query("b09_risk_level", sql("SELECT customerID, risk_level FROM risk"))
def _(spark, sf):
    return scored(spark, sf).select(KEY, risk_level(F.col("churn_prob")).alias("risk_level"))


RISK = "customerID, user_id, churn_prob, risk_score_pct, flagged, true_label, tenure, MonthlyCharges, active_services, risk_level"


def risk(spark, sf):
    return risk_table(scored(spark, sf), KEY, LABEL, "customer_no")


@query("b10_risk_table", sql(f"SELECT {RISK} FROM risk"))
def _(spark, sf):
    return ordered(risk(spark, sf), KEY)


@query("b11_filter_risk", sql(f"SELECT {RISK} FROM risk WHERE flagged = 1 AND churn_prob >= 0.7"))
def _(spark, sf):
    return filter_risk(risk(spark, sf), KEY, True, 0.7, "MonthlyCharges")


@query("b12_filter_log", sql("SELECT user_id, churn_prob, email_subject AS subject FROM outcomes WHERE risk_type = 'support_issue'"))
def _(spark, sf):
    return filter_log(records(spark, sf, pending=True), "support_issue").select("user_id", "churn_prob", "subject")


@query("b13_limit_users", sql("SELECT customerID, churn_prob FROM scored ORDER BY customerID LIMIT 10"))
def _(spark, sf):
    return limit_users(scored(spark, sf).select(KEY, "churn_prob"), KEY, 10)


@query("b14_display_id", sql("SELECT customerID, user_id FROM risk"))
def _(spark, sf):
    return snapshots(spark, sf).select(KEY, display_id(F.col("customer_no")).alias("user_id"))


@query(
    "b15_customer_detail",
    sql(
        f"SELECT customerID, {fixed('risk_score_pct', 1)} || '%' AS churn_probability, risk_level, "
        f"{fixed('tenure', 0)} || ' months' AS tenure_text, '$' || {fixed('MonthlyCharges', 2)} AS charges_text "
        "FROM risk WHERE customerID = '7|1998-04-01'"
    ),
)
def _(spark, sf):
    return customer_detail(risk(spark, sf), KEY, "7|1998-04-01")


@query("b16_contract_from_one_hot", sql("SELECT customerID, coalesce(Contract, 'Month-to-month') AS contract_type FROM panel"))
def _(spark, sf):
    rows = snapshots(spark, sf).select(KEY, "Contract")
    hot = one_hot(rows, fit_levels(rows, ["Contract"]))
    name = contract_from_one_hot(F.col("`Contract_Two year`"), F.col("`Contract_One year`"))
    return hot.select(KEY, name.alias("contract_type"))


@query(
    "b17_decision_profile",
    sql(
        "SELECT customerID, CAST(tenure AS DOUBLE) AS tenure, MonthlyCharges, TotalCharges, Contract AS contract_type, "
        "CAST(active_services AS DOUBLE) AS active_services, is_monthly, is_fiber, SeniorCitizen FROM feat"
    ),
)
def _(spark, sf):
    return profile_for_decision(features(spark, sf), F.col("Contract"), KEY)


# ---- feature columns ----------------------------------------------------------------------


def _column(name: str, expr, sql_expr: str):
    @query(name, sql(f"SELECT customerID, {sql_expr} AS value FROM feat"))
    def _(spark, sf):
        return snapshots(spark, sf).select(KEY, expr().alias("value"))


_column("c01_recency_score", lambda: recency_score(F.col("tenure")), "recency_score")
_column("c02_active_services", active_services, "active_services")
_column("c03_lifetime_value", lambda: lifetime_value(F.col("MonthlyCharges"), F.col("tenure")), "lifetime_value")
_column("c04_charge_per_service", lambda: charge_per_service(F.col("MonthlyCharges"), active_services()), "charge_per_service")
_column("c06_tenure_bucket", lambda: tenure_bucket(F.col("tenure")), "tenure_bucket")


@query("c05_flags", sql("SELECT customerID, is_monthly, is_senior, no_security, is_fiber, is_echeck FROM feat"))
def _(spark, sf):
    return engineer(snapshots(spark, sf)).select(KEY, "is_monthly", "is_senior", "no_security", "is_fiber", "is_echeck")


@query(
    "c07_map_binary",
    sql("SELECT customerID, " + ", ".join(f"CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END AS {c}" for c in TELCO.binary) + " FROM panel"),
)
def _(spark, sf):
    return map_binary(snapshots(spark, sf).select(KEY, *TELCO.binary), list(TELCO.binary))


@query(
    "c08_one_hot",
    sql(
        "SELECT customerID, "
        + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, vs in LEVELS.items() for v in vs)
        + " FROM panel"
    ),
)
def _(spark, sf):
    rows = snapshots(spark, sf).select(KEY, *TELCO.categorical)
    return one_hot(rows, fit_levels(rows, list(TELCO.categorical)))


@query(
    "c09_bools_to_int",
    sql("SELECT customerID, CASE WHEN tenure > 12 THEN 1 ELSE 0 END AS older, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS gone FROM panel"),
)
def _(spark, sf):
    flags = snapshots(spark, sf).select(KEY, (F.col("tenure") > 12).alias("older"), (F.col("Churn") == "Yes").alias("gone"))
    return bools_to_int(flags)


@query("c10_standardize", sql(FITTED + f"SELECT customerID, split, {SCALED_WIDE} FROM wide, fitted"))
def _(spark, sf):
    """All features, unscaled columns in and scaled ones out."""
    rows = prepared(spark, sf).features.select(KEY, "split", *[F.col(f"`{n}`") for n in WIDE])
    scaled = apply_scaler(rows, fit_scaler(rows.where("split = 'train'"), WIDE), "_scaled")
    return scaled.select(KEY, "split", *[F.round(F.col(f"`{n}_scaled`"), DIGITS).alias(f"{n}_scaled") for n in WIDE])


@query("c11_stratified_split", sql("SELECT customerID, Churn_Binary, split FROM parted"))
def _(spark, sf):
    return stratified_split(features(spark, sf).select(KEY, LABEL), KEY, LABEL)


@query(
    "c12_stratified_folds",
    sql(
        """, starts AS (SELECT y, n_c, coalesce(CAST(sum(n_c) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS s FROM class_sizes),
        dealt AS (SELECT y, (s + i) % 5 AS fold FROM starts, generate_series(0, (SELECT max(n_c) FROM class_sizes) - 1) AS g(i) WHERE i < n_c),
        spans AS (SELECT y, fold, sum(count(*)) OVER (PARTITION BY y ORDER BY fold) AS hi, count(*) AS n FROM dealt GROUP BY y, fold)
        SELECT customerID, Churn_Binary, CAST(fold AS INTEGER) AS fold FROM class_ranked
        JOIN spans ON y = Churn_Binary AND class_rank <= hi AND class_rank > hi - n"""
    ),
)
def _(spark, sf):
    return stratified_folds(features(spark, sf).select(KEY, LABEL), KEY, LABEL, 5)


@query(
    "c13_split_summary",
    sql("SELECT split, count(*) AS n_rows, 37 AS n_features, round(avg(Churn_Binary), 9) AS positive_rate FROM parted GROUP BY split"),
)
def _(spark, sf):
    p = prepared(spark, sf)
    return split_summary(p.features, LABEL, len(p.names)).withColumn("positive_rate", F.round("positive_rate", 9))


_FIXED_NAMES = [*TELCO.numeric, *TELCO.binary, *TELCO.engineered]


@query(
    "c14_feature_names",
    sql(
        "SELECT CAST(row_number() OVER (ORDER BY part, feature) AS INTEGER) AS ordinal, feature FROM ("
        + " UNION ALL ".join(f"SELECT {i} AS part, '{n}' AS feature" for i, n in enumerate(_FIXED_NAMES))
        + "".join(
            f" UNION ALL SELECT DISTINCT {100 + i}, '{c}_' || {c} FROM parted WHERE split = 'train' AND {c} IS NOT NULL"
            for i, c in enumerate(TELCO.categorical)
        )
        + ")"
    ),
)
def _(spark, sf):
    names = prepared(spark, sf).names
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "ordinal int, feature string")


@query("c15_preprocess", sql(FITTED + f"SELECT customerID, Churn_Binary, split, {RAW_WIDE}, {SCALED_WIDE} FROM wide, fitted"))
def _(spark, sf):
    return whole_features(prepared(spark, sf).features)


# ---- joins --------------------------------------------------------------------------------


@query(
    "d01_customer_join",
    sql("SELECT customerID, Churn_Binary, split, churn_prob, active_services, gender, Contract FROM parted JOIN (SELECT customerID, churn_prob FROM scored) USING (customerID)"),
)
def _(spark, sf):
    side = prepared(spark, sf).features.select(KEY, LABEL, "split")
    score = scored(spark, sf).select(KEY, "churn_prob", "active_services")
    raw = snapshots(spark, sf).select(KEY, "gender", "Contract")
    return customer_join(side, score, raw, KEY)


@query("d02_metrics_side_by_side", sql(f"SELECT ordinal, metric, base, new FROM {COMPARED}"))
def _(spark, sf):
    return metrics_side_by_side(both_metrics(spark, sf), "base", "new")


@query(
    "d03_lookups",
    sql(
        f"SELECT customerID AS user_id, {case('f1', REASON_LABELS, 'replace(f1, chr(95), chr(32))')} AS reason, {case('risk_type', ROUTING, 'NULL')} AS routing, "
        f"{case('strategy', STRATEGY_TEXT, chr(39) + 'personalized offer' + chr(39))} AS strategy_text FROM decided"
    ),
)
def _(spark, sf):
    rows = decisions(spark, sf)
    first = F.get("top_reasons", F.lit(0))["feature"]
    return rows.select(
        F.col(KEY).alias("user_id"),
        lookup(first, REASON_LABELS, F.regexp_replace(first, "_", " ")).alias("reason"),
        lookup(F.col("risk_type"), ROUTING).alias("routing"),
        lookup(F.col("strategy"), STRATEGY_TEXT, F.lit("personalized offer")).alias("strategy_text"),
    )


@query(
    "d04_customer_features",
    sql(
        ", one AS (SELECT * FROM explained WHERE customerID = '7|1998-04-01') "
        "SELECT customerID, u.f AS feature, u.x AS value, u.c AS contribution FROM (SELECT customerID, unnest(["
        + ", ".join(f"{{'f': '{f}', 'x': CAST({f} AS DOUBLE), 'c': contributions[{i + 1}].c}}" for i, f in enumerate(WEIGHTS))
        + "]) AS u FROM one) ORDER BY abs(u.c) DESC, u.f LIMIT 20"
    ),
)
def _(spark, sf):
    return customer_features(explained(spark, sf), KEY, "7|1998-04-01", list(WEIGHTS))
