"""Sources, sinks, cleaning, encoding, views and the stream."""

from __future__ import annotations

import json

import numpy as np
import pytest
from conftest import SMALL
from planted import planted
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
from catalog import base
from keepline.operators.clean import (
    binary_target, coerce_numeric, drop_exact_duplicates, duplicate_counts, fit_medians, impute,
    impute_constant, store_distinct, trim_strings,
)
from keepline.operators.eda import correlation, histogram, point_density, rate_by, top_level
from keepline.operators.encode import bools_to_int, fit_levels, map_binary, one_hot
from keepline.operators.features import engineer, tenure_bucket
from keepline.operators.profile import class_balance, class_counts, profile, sample_rows
from keepline.operators.scale import apply_scaler, fit_scaler
from keepline.plans.marts import filter_log, ordered, risk_type_breakdown, run_summary
from keepline.plans.preprocess import preprocess
from keepline.plans.reports import markdown, run_report
from keepline.session import as_table, pin, shared_dir
from keepline.sources.customers import (
    MissingSource, RAW_COLUMNS, export_csv, read_checked, read_customers, read_features, write_features,
)
from keepline.sources.log import append_log, read_log, replace_run
from keepline.streaming.decisions import decide_arrivals, start_decisions


@pytest.fixture(scope="module")
def raw(spark):
    return planted(spark, 400)


def test_csv_round_trip(spark, raw, tmp_path):
    path = str(tmp_path / "csv")
    export_csv(raw, path)
    back = read_customers(spark, path)
    assert back.columns == list(RAW_COLUMNS)
    assert sorted(back.collect()) == sorted(raw.collect())
    assert back.where(F.col("TotalCharges") == " ").count() > 0


def test_missing_source(spark, tmp_path):
    with pytest.raises(MissingSource):
        read_customers(spark, str(tmp_path / "nowhere"))
    with pytest.raises(MissingSource):
        read_features(spark, str(tmp_path / "nowhere"), "test")


def test_split_is_a_partition(spark, raw, tmp_path):
    path = str(tmp_path / "features")
    half = F.when(F.col("tenure") > 30, F.lit("test")).otherwise(F.lit("train"))
    write_features(raw.withColumn("split", half), path)
    test = read_features(spark, path, "test")
    assert test.count() == raw.where("tenure > 30").count()
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


LOG_ROWS = (
    "user_id string, timestamp string, churn_prob double, risk_type string, discount_pct int, eligible boolean, "
    "subject string, body string, top_reasons array<string>, strategy string, status string"
)


def entry(user, kind="disengagement"):
    return (user, "2024-01-01T00:00:00", 0.9, kind, 10, True, "Hi", "line\nline", ["a", "b"], "discount_offer", "simulated")


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_log(spark, path).count() == 0
    one = spark.createDataFrame([entry("u1"), entry("u2", "support_issue")], LOG_ROWS)
    append_log(one, path, "r1")
    append_log(spark.createDataFrame([entry("u3")], LOG_ROWS), path, "r1")
    append_log(spark.createDataFrame([entry("u4")], LOG_ROWS), path, "r2")
    assert sorted((r["run_id"], r["user_id"]) for r in read_log(spark, path).collect()) == [
        ("r1", "u1"), ("r1", "u2"), ("r1", "u3"), ("r2", "u4"),
    ]
    replace_run(spark.createDataFrame([entry("u5")], LOG_ROWS), path, "r1")
    assert sorted(r["user_id"] for r in read_log(spark, path).collect()) == ["u4", "u5"]
    replace_run(one.where("user_id = 'none'"), path, "r1")
    assert sorted(r["user_id"] for r in read_log(spark, path).collect()) == ["u4"]
    bad = tmp_path / "log" / "run_id=r3"
    bad.mkdir()
    (bad / "part.json").write_text('{"user_id": "u6", "churn_\n' + json.dumps({"user_id": "u7"}) + "\n")
    assert sorted(r["user_id"] for r in read_log(spark, path).collect()) == ["u4", "u7"]
    assert read_log(spark, path).count() == 2
    assert read_log(spark, path).where("user_id = 'u4'").first()["body"] == "line\nline"
    with pytest.raises(ValueError):
        append_log(one, path, "../x")


def test_filter_log(spark):
    rows = spark.createDataFrame([entry("u1"), entry("u2", "support_issue")], LOG_ROWS)
    assert filter_log(rows).count() == 2 and filter_log(rows, "support_issue").first()["user_id"] == "u2"


def test_profile(spark, raw):
    dirty = raw.withColumn("Partner", F.when(F.col("tenure") > 5, F.col("Partner")))
    got = {r["column_name"]: r for r in profile(dirty).collect()}
    assert got["Partner"]["nulls"] == dirty.where("Partner is null").count()
    assert got["tenure"]["dtype"] == "int" and got["Churn"]["n_rows"] == 400 and len(got) == 21
    shares = class_counts(raw, "Churn").agg(F.sum("share")).first()[0]
    assert abs(shares - 1) < 1e-12
    assert class_balance(raw.where("tenure < 0"), "Churn").count() == 0
    assert [r["customerID"] for r in sample_rows(raw, "customerID").collect()] == ["C000000", "C000001", "C000002"]


def test_cleaning(spark):
    rows = spark.createDataFrame(
        [(" a ", "1", "Yes"), (" a ", "1", "Yes"), ("b", " ", None), ("c", "x", "No"), (None, "4", "yes")],
        "s string, n string, t string",
    )
    done = binary_target(coerce_numeric(trim_strings(rows), ["n"]), "t", "Yes", "y")
    counts = duplicate_counts(done).first()
    assert (counts["rows_before"], counts["rows_after"], counts["removed"]) == (5, 4, 1)
    unique = drop_exact_duplicates(done)
    filled = impute(unique, fit_medians(unique, ["n"]))
    assert {(r["s"], r["n"], r["y"]) for r in filled.collect()} == {("a", 1.0, 1), ("b", 2.5, 0), ("c", 2.5, 0), (None, 4.0, 0)}
    assert impute_constant(unique, ["n"], 0.0).where("n = 0").count() == 2
    empty = coerce_numeric(rows.where("s = 'zz'"), ["n"])
    assert impute(empty, fit_medians(empty, ["n"])).count() == 0
    assert duplicate_counts(empty).first()["rows_before"] == 0


def test_encoding(spark):
    rows = spark.createDataFrame(
        [("Yes", "x y"), ("No", "z"), ("No phone service", None), ("maybe", "x y"), (None, "q")], "b string, c string"
    )
    assert [r["b"] for r in map_binary(rows, ["b"]).collect()] == [1, 0, 0, 0, 0]
    levels = fit_levels(rows.where("c is null or c <> 'q'"), ["c"])
    assert levels == {"c": ("x y", "z")}
    hot = one_hot(rows, levels)
    assert hot.columns == ["b", "c_x y", "c_z"]
    assert [tuple(r)[1:] for r in hot.collect()] == [(1, 0), (0, 1), (0, 0), (1, 0), (0, 0)]
    with pytest.raises(ValueError):
        fit_levels(spark.range(50).select(F.col("id").cast("string").alias("c")), ["c"], max_levels=10)
    assert bools_to_int(rows.select((F.col("b") == "Yes").alias("f"))).first()["f"] == 1


def test_features(spark, raw):
    edges = spark.createDataFrame([(0,), (12,), (13,), (36,), (37,), (None,)], "t int")
    assert [r[0] for r in edges.select(tenure_bucket(F.col("t"))).collect()] == [0, 0, 1, 1, 2, None]
    done = engineer(raw)
    r = done.orderBy("customerID").first()
    assert r["recency_score"] == 1 / (r["tenure"] + 1)
    assert r["lifetime_value"] == r["MonthlyCharges"] * r["tenure"]
    assert done.where("active_services < 0 or active_services > 8").count() == 0
    plan = done.select("is_monthly")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_distinct_rows_of_many(spark):
    one = [(1, "a", 0.5), (1, "a", 0.5), (1, "b", 0.5), (None, "a", None), (None, "a", None), (2, None, -0.0), (2, None, 0.0)]
    copied = spark.createDataFrame(one, "k int, `t.x` string, v double")
    single = spark.range(100).select(F.col("id").cast("int").alias("k"), F.lit("z").alias("t.x"), F.lit(1.5).alias("v"))
    for rows in (copied, copied.unionByName(single), single, single.where("k < 0"), single.unionByName(single)):
        want = sorted(map(str, rows.dropDuplicates().collect()))
        for few in (0, 1_000):
            got = store_distinct(rows, "distinct", few)
            assert got.dtypes == rows.dtypes and sorted(map(str, got.collect())) == want


def test_scaler_over_tasks_and_nulls(spark):
    x = np.random.default_rng(3).normal(1e6, 1e-2, 1_000)
    rows = spark.createDataFrame([(float(v), 0.1, None if i % 3 else i, None) for i, v in enumerate(x)], "x double, k double, n int, `no.ne` int")
    got = {r["feature"]: (r["mean"], r["scale"]) for r in fit_scaler(rows.repartition(7), ["x", "k", "n", "no.ne"]).collect()}
    some = np.arange(0, 1_000, 3)
    assert got["k"] == (0.1, 1.0) and got["no.ne"] == (None, None)
    assert np.allclose(got["x"], (x.mean(), x.std()), rtol=1e-9) and np.allclose(got["n"], (some.mean(), some.std()), rtol=1e-12)


def test_only_raw_features_are_stored(spark):
    ready = preprocess(planted(spark))
    stored = spark.read.parquet(*ready.features.inputFiles()).columns
    assert set(ready.names) < set(stored) and not set(ready.scaled_names) & set(stored)
    assert set(ready.scaled_names) < set(ready.features.columns)


def test_scaler_with_constant_column(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    params = fit_scaler(rows, ["x", "k"])
    assert {r["feature"]: r["scale"] for r in params.collect()} == {"x": 1.0, "k": 1.0}
    got = apply_scaler(rows, params, "_z").orderBy("x").collect()
    assert [(r["x_z"], r["k_z"], r["x"]) for r in got] == [(-1.0, 0.0, 1.0), (1.0, 0.0, 3.0)]


def test_eda(spark, raw):
    rows = binary_target(raw, "Churn", "Yes", "y")
    rates = rate_by(rows, ["Contract", "gender"], "y").collect()
    assert len(rates) == 3 + 2 + 1 and sum(r["n"] for r in rates if r["feature"] == "gender") == 400
    best = max((r for r in rates if r["feature"] == "Contract"), key=lambda r: r["rate"])
    assert top_level(rows, "Contract", "y").first()["Contract"] == best["level"]
    bars = histogram(rows, "tenure", "Churn", 10).collect()
    assert sum(b["n"] for b in bars) == 400 and max(b["bin"] for b in bars) == 9
    flat = histogram(rows.withColumn("k", F.lit(3.0)), "k", None, 5, density=False).collect()
    assert len(flat) == 1 and flat[0]["share"] == 1.0
    assert correlation(rows, ["tenure", "tenure", "y"]).count() == 3
    grid = point_density(rows, "tenure", "MonthlyCharges", "Churn", 10.0, 25.0)
    assert grid.agg(F.sum("n")).first()[0] == 400


def test_views_reject_unknown_sort(spark, raw):
    with pytest.raises(ValueError):
        ordered(raw, "customerID", "gender")


def test_run_report_of_a_quiet_run(spark):
    outcomes = base.outcomes(spark, SMALL).where("action = 'no_action'")
    shares = {r["risk_type"]: (r["n"], r["pct_of_flagged"]) for r in risk_type_breakdown(outcomes).collect()}
    assert shares == {"disengagement": (0, 0.0), "support_issue": (0, 0.0)}
    report = run_report(outcomes, base.scored(spark, SMALL))
    assert report.flagged.count() == 0
    assert "| 2 | Flagged (above threshold) | 0 |" in markdown("Summary", report.summary, "ordinal")
    assert run_summary(outcomes, base.scored(spark, SMALL)).first()["eligible"] == 0


def test_pin_checks_its_size(spark):
    small = pin(spark.range(5), 5)
    assert "LocalTableScan" in small._jdf.queryExecution().executedPlan().toString() or small.count() == 5
    with pytest.raises(ValueError, match="more than 5 rows"):
        pin(spark.range(6), 5)


def test_written_table_cuts_lineage(spark):
    table = as_table(spark.range(10).withColumn("x", F.rand()), "t")
    assert table.collect() == table.collect()
    assert shared_dir(spark) in table.inputFiles()[0]


def test_key_filter_reaches_the_scan(spark):
    plan = entrypoint.queries()["b15_customer_detail"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(customerID,7|1998-04-01)" in plan


def test_stream_equals_batch(spark, tmp_path):
    snapshots = base.snapshots(spark, SMALL)
    source = tmp_path / "in"
    doubled = snapshots.unionByName(snapshots.limit(50)).withColumn("at", F.col("as_of").cast("timestamp"))
    doubled.write.parquet(str(source))
    coefs = base.coefficients(spark)
    means = base.once(spark, SMALL, "means", lambda: base.feature_means(base.scored(spark, SMALL), list(base.WEIGHTS)))
    arrivals = spark.readStream.schema(doubled.schema).parquet(str(source))
    decided = decide_arrivals(arrivals, coefs, means, event_time="at", delay="3000 days")
    query = start_decisions(decided, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = decide_arrivals(snapshots, coefs, means)
    columns = ["customerID", "risk_type", "eligible", "discount_pct", "strategy", "ltv"]
    assert sorted(got.select(*columns).collect()) == sorted(batch.select(*columns).collect())


def test_a_failed_job_leaves_the_earlier_run(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([entry("u1"), entry("u2")], LOG_ROWS)
    replace_run(one, path, "r1")
    replace_run(one.where("user_id = 'u1'"), path, "r2")
    broken = one.withColumn("body", F.when(F.col("user_id") == "u2", F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        replace_run(broken, path, "r1")
    assert sorted((r["run_id"], r["user_id"]) for r in read_log(spark, path).collect()) == [("r1", "u1"), ("r1", "u2"), ("r2", "u1")]
    # a run may be replaced by what it is itself read for
    replace_run(read_log(spark, path).where("run_id = 'r1' and user_id = 'u2'").drop("run_id"), path, "r1")
    assert sorted((r["run_id"], r["user_id"]) for r in read_log(spark, path).collect()) == [("r1", "u2"), ("r2", "u1")]


def test_damaged_lines_are_set_apart(spark, tmp_path):
    header = ",".join(RAW_COLUMNS)
    good = "A1,Male,0,Yes,No,5,Yes,No,DSL,No,No,No,No,No,No,One year,Yes,Mailed check,20.5, ,No"
    bad = [good.replace("A1", "B1").replace(",5,", ",five,"), good.replace("A1", "B2").replace("20.5", "twenty"), "B3,Male,0"]
    (tmp_path / "c.csv").write_text("\n".join([header, good, *bad, good.replace("A1", "A2")]) + "\n")
    rows, damaged = read_checked(spark, str(tmp_path / "c.csv"))
    assert sorted(r["customerID"] for r in rows.collect()) == ["A1", "A2"] and list(rows.columns) == list(RAW_COLUMNS)
    assert sorted(r["line"] for r in damaged.collect()) == sorted(bad)
    with pytest.raises(MissingSource):
        read_checked(spark, str(tmp_path / "none.csv"))


def test_correlation_of_many_columns(spark):
    """Against numpy, with a large mean, nulls in some rows, a constant and a null column."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6))
    x[:, 1] = x[:, 0] * 0.5 + x[:, 1]
    x[:, 2] = x[:, 2] * 1e-3 + 1e9
    x[:, 4] = 7.0
    missing = rng.random(500) < 0.3
    rows = [[None if (j == 3 and missing[i]) or j == 5 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    names = [f"c {j}" for j in range(6)]
    got = correlation(spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(7), names).collect()
    assert len(got) == 15
    for r in got:
        i, j = names.index(r["row_name"]), names.index(r["col_name"])
        assert j < i
        if i >= 4 or j >= 4:
            assert r["corr"] is None
            continue
        use = ~missing if 3 in (i, j) else np.ones(500, dtype=bool)
        assert r["corr"] == pytest.approx(np.corrcoef(x[use, i], x[use, j])[0, 1], abs=1e-7)
