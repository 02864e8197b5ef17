"""The message log: JSON lines, one directory per run."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepline.session import as_table

LOG_SCHEMA = (
    "user_id string, timestamp string, churn_prob double, risk_type string, discount_pct int, "
    "eligible boolean, subject string, body string, top_reasons array<string>, strategy string, "
    "status string"
)
_BAD = "_corrupt_record"


def append_log(records: DataFrame, path: str, run_id: str) -> None:
    """Add a run's records. Each run has its own folder, so nothing is read or rewritten."""
    records.write.mode("append").json(_run_folder(path, run_id))


def replace_run(records: DataFrame, path: str, run_id: str) -> None:
    """Write a run afresh: its earlier records go, other runs stay.

    The safe choice when a job may be started twice, or may fail: see `replace_partition`.
    """
    replace_partition(records, path, run_id, "json")


def replace_partition(rows: DataFrame, path: str, run_id: str, format: str, **options) -> None:
    """Replace one run's folder of a table that has a folder per run.

    The rows are worked out and stored elsewhere first, and then written by Spark's dynamic partition
    overwrite, which moves them in when all are written: a job that fails on the way leaves the earlier
    run readable. No rows clear the run.
    """
    folder = _run_folder(path, run_id)
    staged = as_table(rows, "staged")
    if staged.isEmpty():
        staged.write.mode("overwrite").format(format).options(**options).save(folder)
        return
    writer = staged.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").format(format).options(**options)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("run_id").save(path)


def _run_folder(path: str, run_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError("run ids are letters, digits, '_', '.', '-'")
    return f"{path}/run_id={run_id}"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All readable records; damaged lines are skipped and a missing log is empty."""
    schema = f"{LOG_SCHEMA}, run_id string"
    try:
        raw = (
            spark.read.schema(f"{schema}, {_BAD} string")
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", _BAD)
            .json(path)
        )
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise
    # Spark refuses plans that read nothing but the damaged-line column, so a count of the log
    # needs a second one; a record without a user is no record.
    good = F.col(_BAD).isNull() & F.col("user_id").isNotNull()
    return raw.where(good).drop(_BAD)
