"""From a raw file to decisions, step by step, as a user runs it."""

from __future__ import annotations

import pytest
from planted import planted
from pyspark.sql import functions as F

from keepline.__main__ import arguments, main
from keepline.plans import runs
from keepline.sources.customers import export_csv, verify_source
from keepline.sources.log import read_log


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("workspace")
    raw = planted(spark, 3000)
    export_csv(raw.unionByName(raw.limit(100)), str(folder / "raw"))
    return str(folder)


def test_steps(spark, workspace):
    raw = f"{workspace}/raw"
    assert verify_source(spark, raw).first().asDict() == {"n_rows": 3100, "n_cols": 21}
    assert runs.verify(spark, raw)["balance"].count() == 2
    assert runs.explore(spark, raw, workspace)["rates"].count() == 3 + 3 + 4 + 1

    noted = runs.note_batch(spark, raw, workspace, "b1")
    assert noted["rates"].count() == 11
    assert {r["n_rows"] for r in noted["columns"].collect()} == {3100}

    ready = runs.prepare(spark, raw, workspace)
    counts = {r["split"]: r["count"] for r in ready.features.groupBy("split").count().collect()}
    assert counts == {"train": 2400, "test": 600}

    base = {r["metric"]: r["value"] for r in runs.fit_baseline(spark, workspace).collect()}
    assert base["roc_auc"] > 0.7
    grid = {"trees": (10,), "depth": (2, 3)}
    tuned = {r["metric"]: r["value"] for r in runs.fit_boosted(spark, workspace, grid=grid, folds=2).collect()}
    assert tuned["roc_auc"] > 0.7
    comparison = spark.read.parquet(f"{workspace}/metrics/comparison").collect()
    assert len(comparison) == 5

    done = runs.attribute(spark, workspace)
    assert done["rows"].count() == 600 and done["importance"].count() == 15

    report, page = runs.run_decisions(spark, workspace, "r1")
    outcomes = spark.read.parquet(f"{workspace}/outcomes/run_id=r1")
    assert outcomes.count() == 600
    flagged = outcomes.where("action = 'pending'")
    n_flagged = flagged.count()
    assert n_flagged > 0 and outcomes.where("action = 'email_sent' or email_subject is not null").count() == 0
    assert read_log(spark, f"{workspace}/log").count() == 0  # nothing is logged before it is written
    lines = {r["metric"]: r["value"] for r in report.summary.collect()}
    assert lines["Emails generated"] == "0" and lines["Emails not yet written"] == str(n_flagged)
    assert report.flagged.count() == min(20, flagged.count()) and "# Run r1" in page

    written = "\n".join(r["value"] for r in spark.read.text(f"{workspace}/reports/r1").collect())
    assert "# Run r1" in written and "Mode: whole test side" in written
    assert spark.read.text(f"{workspace}/reports/boosted").count() > 5

    unclear = spark.read.parquet(f"{workspace}/prompts/r1/classify")
    n_unclear = unclear.count()
    replies = unclear.select("customerID", F.lit("support_issue").alias("reply"))
    messages = spark.read.parquet(f"{workspace}/prompts/r1/messages")
    assert messages.count() == n_flagged
    texts = runs.write_messages(spark, workspace, "r1", lambda: (lambda prompt: "Subject: Hello\n\nHi"))
    assert texts.count() == n_flagged
    one = runs.customer(spark, workspace, "r1", messages.first()["customerID"]).collect()
    assert len(one) == 1 and one[0]["churn_probability"].endswith("%")
    runs.run_decisions(spark, workspace, "r1", replies=replies, texts=texts)
    again = read_log(spark, f"{workspace}/log")
    assert again.count() == n_flagged
    assert again.where("subject = 'Hello'").count() == n_flagged
    assert again.where("risk_type = 'support_issue'").count() >= n_unclear
    assert spark.read.parquet(f"{workspace}/prompts/r1/messages").count() == 0

    runs.run_decisions(spark, workspace, "trial", limit=10)
    assert spark.read.parquet(f"{workspace}/outcomes/run_id=trial").count() == 10


def test_command_line(spark, workspace, capsys, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    assert arguments(["decide", "--workspace", "w", "--test", "--size", "5"]).size == 5
    main(["verify", "--input", f"{workspace}/raw"])
    assert "balance" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        arguments(["nonsense"])


def test_task_sizes_follow_the_delivered_values_only(spark):
    from keepline.session import SIZES, as_table

    limit, splits = "spark.sql.codegen.hugeMethodLimit", "spark.sql.files.maxPartitionBytes"
    before = {name: spark.conf.get(name) for name in SIZES}
    try:
        spark.conf.set(splits, "7m")
        spark.conf.unset(limit)
        assert as_table(spark.range(3), "three").count() == 3
        assert spark.conf.get(splits) == "7m" and spark.conf.get(limit) == "8000"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_splits_of_wide_tables_are_small():
    from keepline.session import SIZES

    assert SIZES["spark.sql.files.maxPartitionBytes"] == ("134217728b", "16m")


def test_shuffle_partitions_follow_the_rows(spark):
    """Few rows leave the session's number, more raise it, and a number set by the caller stands."""
    from keepline import session

    advisory, least = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    first, before = session.FIRST_PARTITIONS, spark.conf.get(advisory)
    try:
        session.shuffled(spark, 8 * session.ROWS_A_PARTITION)
        assert spark.conf.get(first, None) is None
        session.shuffled(spark, 20 * session.ROWS_A_PARTITION)
        session.shuffled(spark, 40 * session.ROWS_A_PARTITION)
        session.shuffled(spark, 30 * session.ROWS_A_PARTITION)
        assert spark.conf.get(first) == "40"
        spark.conf.set(advisory, "10k")
        spark.conf.set(least, "1k")
        assert spark.range(200_000).selectExpr("id * 7 % 150000 AS k").groupBy("k").count().rdd.getNumPartitions() > 8
        spark.conf.set(first, "3")
        session.shuffled(spark, 40 * session.ROWS_A_PARTITION)
        assert spark.conf.get(first) == "3"
    finally:
        spark.conf.set(advisory, before)
        spark.conf.unset(least)
        spark.conf.unset(first)
        session._first_partitions.clear()


def test_shuffle_partitions_of_the_panel_stay_few(spark):
    """One for each million order lines: smaller ones cost time and hardly save memory."""
    from keepline import session

    try:
        session.shuffled(spark, 9_999_999)
        assert spark.conf.get(session.FIRST_PARTITIONS) == "9"
    finally:
        spark.conf.unset(session.FIRST_PARTITIONS)
        session._first_partitions.clear()
