"""Sources, sinks, profiling and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    KEY, LABEL, decisions, outcomes, prepared, scored, scored_twice, snapshots, texts,
)
from catalog.registry import query
from catalog.sql import FITTED, RAW, RAW_WIDE, SCALED_WIDE, WIDE, case, exact, fixed, scaled_round, signed, sql
from keepline.operators.evaluate import evaluate_models
from keepline.operators.messages import message_records
from keepline.operators.profile import class_balance, profile, sample_rows, target_values
from keepline.plans.marts import ordered, risk_table
from keepline.plans.reports import METRIC_LABELS, model_report, run_report
from keepline.session import new_path
from keepline.sources.artefacts import load_params, save_params
from keepline.sources.customers import (
    export_csv, read_checked, read_customers, read_features, verify_source, write_features,
)
from keepline.sources.log import append_log, read_log, replace_run

_RAW = ", ".join(RAW)


@query("a01_read_customers", sql(f"SELECT {_RAW} FROM panel"))
def _(spark, sf):
    path = new_path(spark, "customers-csv")
    export_csv(snapshots(spark, sf).select(*RAW), path)
    return read_customers(spark, path)


_KINDS = {c: "string" for c in RAW} | {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}
_PROFILE = " UNION ALL ".join(
    f"SELECT CAST(count(*) AS BIGINT) AS n_rows, 21 AS n_cols, {i + 1} AS ordinal, '{c}' AS column_name, "
    f"'{_KINDS[c]}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM panel"
    for i, c in enumerate(RAW)
)


@query("a02_profile", sql(_PROFILE))
def _(spark, sf):
    return profile(snapshots(spark, sf).select(*RAW))


@query("a02_target_values", sql("SELECT DISTINCT Churn FROM panel"))
def _(spark, sf):
    return target_values(snapshots(spark, sf), "Churn")


@query(
    "a03_class_balance",
    sql(
        "SELECT Churn, n, " + scaled_round("CAST(n AS DOUBLE) / total * 100", 1) + " AS percent FROM "
        "(SELECT Churn, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM panel GROUP BY Churn)"
    ),
)
def _(spark, sf):
    return class_balance(snapshots(spark, sf), "Churn")


@query("a04_sample_rows", sql(f"SELECT {_RAW} FROM panel ORDER BY customerID LIMIT 3"))
def _(spark, sf):
    return sample_rows(snapshots(spark, sf).select(*RAW), KEY)


@query("a05_verify_source", sql("SELECT count(*) AS n_rows, 21 AS n_cols FROM panel"))
def _(spark, sf):
    path = new_path(spark, "customers-csv")
    export_csv(snapshots(spark, sf).select(*RAW), path)
    return verify_source(spark, path)


def whole_features(rows):
    """Every column of a feature table; numbers as doubles with six decimals."""
    names = [f"`{c}`" for n in WIDE for c in (n, f"{n}_scaled")]
    return rows.select(KEY, LABEL, "split", *[F.round(F.col(c).cast("double"), 6).alias(c.strip("`")) for c in names])


@query("a06_write_features", sql(FITTED + f"SELECT customerID, Churn_Binary, split, {RAW_WIDE}, {SCALED_WIDE} FROM wide, fitted"))
def _(spark, sf):
    path = new_path(spark, "feature-store")
    write_features(prepared(spark, sf).features, path)
    return whole_features(read_features(spark, path))


@query(
    "a07_saved_parameters",
    sql(
        FITTED + "SELECT u.f AS feature, round(u.m, 6) AS mean, round(u.s, 6) AS scale FROM (SELECT unnest(["
        + ", ".join(f"{{'f': '{n}', 'm': \"m_{n}\", 's': CASE WHEN \"s_{n}\" = 0 THEN 1.0::DOUBLE ELSE \"s_{n}\" END}}" for n in WIDE)
        + "]) AS u FROM fitted)"
    ),
)
def _(spark, sf):
    path = new_path(spark, "scaler")
    save_params(prepared(spark, sf).scaler, path)
    return load_params(spark, path).select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query("a08_read_test_side", sql(FITTED + f"SELECT customerID, Churn_Binary, {RAW_WIDE}, {SCALED_WIDE} FROM wide, fitted WHERE split = 'test'"))
def _(spark, sf):
    path = new_path(spark, "feature-store")
    write_features(prepared(spark, sf).features, path)
    return whole_features(read_features(spark, path, "test")).drop("split")


@query("a01_quarantine", sql("SELECT count(*) AS n_rows, count(*) FILTER (tenure % 7 = 3) AS n_damaged, sum(CASE WHEN tenure % 7 = 3 THEN 0 ELSE tenure END)::BIGINT AS tenure FROM panel"))
def _(spark, sf):
    """A file in which every tenure of 3, 10, 17, .. is unreadable: those rows are set apart, the others stay."""
    path = new_path(spark, "damaged-csv")
    rows = snapshots(spark, sf).select(*RAW)
    broken = F.when(F.col("tenure") % 7 == 3, F.concat(F.col("tenure").cast("string"), F.lit(" months"))).otherwise(F.col("tenure").cast("string"))
    export_csv(rows.withColumn("tenure", broken), path)
    good, damaged = read_checked(spark, path)
    total = good.agg(F.count(F.lit(1)).alias("n"), F.sum("tenure").alias("tenure"))
    n = damaged.agg(F.count(F.lit(1)))
    return total.select((F.col("n") + n.scalar()).alias("n_rows"), n.scalar().alias("n_damaged"), "tenure")


def records(spark, sf, pending=False):
    """Log records of the customers with a written message, stamped with their snapshot date; with
    ``pending`` also of those whose message is yet to be written."""
    ready = decisions(spark, sf).join(texts(spark, sf), KEY, "left")
    return message_records(ready, KEY, stamp=F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss"), pending=pending)


_LOGGED = (
    "SELECT user_id, {run} AS run_id, churn_prob, risk_type, discount_pct, email_subject AS subject, body, strategy, "
    "reasons_text FROM outcomes WHERE action = 'email_sent' {where}"
)
_LOG_COLUMNS = ("user_id", "run_id", "churn_prob", "risk_type", "discount_pct", "subject", "body", "strategy")


@query(
    "a09_append_log",
    sql(_LOGGED.format(run="'r1'", where="") + " UNION ALL " + _LOGGED.format(run="'r2'", where="AND eligible")),
)
def _(spark, sf):
    path = new_path(spark, "log")
    rows = records(spark, sf)
    append_log(rows, path, "r1")
    append_log(rows.where("eligible"), path, "r2")
    return read_log(spark, path).select(*_LOG_COLUMNS, F.array_join("top_reasons", ", ").alias("reasons_text"))


@query(
    "a10_replace_run",
    sql(
        _LOGGED.format(run="'r1'", where="AND risk_type = 'support_issue'")
        + " UNION ALL " + _LOGGED.format(run="'r2'", where="AND eligible")
    ),
)
def _(spark, sf):
    path = new_path(spark, "log")
    rows = records(spark, sf)
    append_log(rows, path, "r1")
    append_log(rows.where("eligible"), path, "r2")
    replace_run(rows.where("risk_type = 'support_issue'"), path, "r1")
    return read_log(spark, path).select(*_LOG_COLUMNS, F.array_join("top_reasons", ", ").alias("reasons_text"))


_RISK = "customerID, user_id, churn_prob, risk_score_pct, flagged, true_label, tenure, MonthlyCharges, active_services, risk_level"


@query("a11_export_csv", sql(f"SELECT {_RISK} FROM risk"))
def _(spark, sf):
    risk = risk_table(scored(spark, sf), KEY, LABEL, "customer_no")
    path = new_path(spark, "risk-csv")
    export_csv(ordered(risk, KEY), path)
    return spark.read.schema(risk.schema).option("header", True).csv(path)


@query(
    "a12_run_report_summary",
    sql(
        """, t AS (SELECT count(*) AS n, count(*) FILTER (action <> 'no_action') AS f, count(*) FILTER (eligible) AS e,
             count(*) FILTER (action = 'email_sent') AS w, (SELECT avg(churn_prob) FROM scored) AS m FROM outcomes)
        SELECT 1 AS ordinal, 'Total users processed' AS metric, format('{:,}', n) AS value FROM t
        UNION ALL SELECT 2, 'Flagged (above threshold)', format('{:,}', f) FROM t
        UNION ALL SELECT 3, 'Below threshold (no action)', format('{:,}', n - f) FROM t
        UNION ALL SELECT 4, 'Emails generated', format('{:,}', w) FROM t
        UNION ALL SELECT 5, 'Emails not yet written', format('{:,}', f - w) FROM t
        UNION ALL SELECT 6, 'Discount eligible', format('{:,}', e) FROM t
        UNION ALL SELECT 7, 'Avg churn probability', """ + fixed("m * 100.0::DOUBLE", 1) + " || '%' FROM t"
    ),
)
def _(spark, sf):
    return run_report(outcomes(spark, sf), scored(spark, sf)).summary


_BREAKDOWN = """, t AS (SELECT count(*) AS f FROM outcomes WHERE action <> 'no_action'),
  k AS (SELECT unnest(['disengagement', 'support_issue']) AS risk_type),
  c AS (SELECT k.risk_type, count(o.risk_type) AS n FROM k LEFT JOIN outcomes o ON o.risk_type = k.risk_type GROUP BY 1)
"""


@query(
    "a12_run_report_types",
    sql(_BREAKDOWN + "SELECT risk_type, n, " + fixed("CAST(n AS DOUBLE) / greatest(f, 1) * 100", 1) + " || '%' AS pct_text FROM c, t"),
)
def _(spark, sf):
    return run_report(outcomes(spark, sf), scored(spark, sf)).breakdown.select("risk_type", "n", "pct_text")


@query(
    "a12_run_report_flagged",
    sql(
        "SELECT user_id, " + fixed("churn_prob * 100.0::DOUBLE", 1) + " || '%' AS churn_prob_text, risk_type, "
        "discount_pct || '%' AS discount, substring(email_subject, 1, 40) AS subject FROM outcomes "
        "WHERE action <> 'no_action' ORDER BY user_id LIMIT 20"
    ),
)
def _(spark, sf):
    return run_report(outcomes(spark, sf), scored(spark, sf)).flagged


def metrics_sql(prob: str, name: str) -> str:
    """Long metric table of one score column at cut-off 0.5."""
    return f"""(
      SELECT '{name}' AS model, u.o AS ordinal, u.m AS metric, u.v AS value FROM (
        SELECT unnest([
          {{'o': 1, 'm': 'accuracy', 'v': {exact("CAST(tp + tn AS DOUBLE) / n", 4)}}},
          {{'o': 2, 'm': 'precision', 'v': CASE WHEN tp + fp = 0 THEN 0.0 ELSE {exact("CAST(tp AS DOUBLE) / (tp + fp)", 4)} END}},
          {{'o': 3, 'm': 'recall', 'v': CASE WHEN tp + fn = 0 THEN 0.0 ELSE {exact("CAST(tp AS DOUBLE) / (tp + fn)", 4)} END}},
          {{'o': 4, 'm': 'f1', 'v': CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE {exact("CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn)", 4)} END}},
          {{'o': 5, 'm': 'roc_auc', 'v': {exact("area / p / neg", 4)}}}
        ]) AS u
        FROM (SELECT count(*) AS n, count(*) FILTER (y = 1 AND s >= 0.5) AS tp, count(*) FILTER (y = 0 AND s >= 0.5) AS fp,
                     count(*) FILTER (y = 1 AND s < 0.5) AS fn, count(*) FILTER (y = 0 AND s < 0.5) AS tn
              FROM (SELECT Churn_Binary AS y, {prob} AS s FROM scored)),
             (SELECT sum(neg_g * (above + pos_g / 2.0::DOUBLE)) AS area, CAST(sum(pos_g) AS DOUBLE) AS p, CAST(sum(neg_g) AS DOUBLE) AS neg
              FROM (SELECT *, coalesce(CAST(sum(pos_g) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0) AS above
                    FROM (SELECT {prob} AS s, CAST(sum(Churn_Binary) AS DOUBLE) AS pos_g, CAST(sum(1 - Churn_Binary) AS DOUBLE) AS neg_g
                          FROM scored GROUP BY 1)))
      ))"""


COMPARED = (
    "(SELECT b.ordinal, b.metric, b.value AS base, m.value AS new, (m.value - b.value) * 100 AS delta FROM "
    + metrics_sql("other_prob", "base") + " b JOIN " + metrics_sql("churn_prob", "new") + " m USING (metric))"
)


def both_metrics(spark, sf):
    return evaluate_models(scored_twice(spark, sf), {"base": "other_prob", "new": "churn_prob"}, LABEL)


@query(
    "a13_model_report",
    sql(
        f"SELECT ordinal, {case('metric', METRIC_LABELS, 'metric')} AS metric_label, {fixed('base * 100', 2)} || '%' AS base_text, "
        f"{fixed('new * 100', 2)} || '%' AS new_text, {signed('delta', 2)} || '%' AS improvement FROM {COMPARED}"
    ),
)
def _(spark, sf):
    return model_report(both_metrics(spark, sf), "base", "new")
