"""Shared-folder tables and small parameter tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Setting -> value as delivered with Spark, value that `sized` puts in its place.
SIZES = {
    "spark.sql.codegen.hugeMethodLimit": ("65535", "8000"),
    "spark.sql.files.maxPartitionBytes": ("134217728b", "16m"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "16m"),
}

FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ROWS_A_PARTITION = 1_000_000

_first_partitions: dict[str, str] = {}
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str | None:
    """Folder that every node can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster without the
    setting there is no safe place and the answer is None.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        return None
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="keepline-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    base = shared_dir(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{base}/keepline/{spark.conf.get('spark.app.id', 'app')}/{name}-{uuid.uuid4().hex}"


def sized(spark: SparkSession) -> None:
    """Settings for tables that are narrow on disk and wide in memory, each only where Spark's own value stands.

    A split of 128 MB of such a table holds millions of rows, and what a task keeps of them while it groups
    or sorts grows with them; smaller splits and shuffle partitions bound it. Columns beyond 8,000 bytes of byte code are
    worked out expression by expression: the JVM does not compile a longer method, and interprets it row by row.
    """
    for name, (delivered, wanted) in SIZES.items():
        if spark.conf.get(name, delivered) == delivered:
            spark.conf.set(name, wanted)


def shuffled(spark: SparkSession, rows: int) -> None:
    """Shuffle partitions for tables of about so many rows, where the session has fewer.

    Adaptive execution only joins small partitions; a fixed few would grow with the input, and what a
    task holds with them. A number set by the caller stands.
    """
    app, set_to = spark.conf.get("spark.app.id", "local"), spark.conf.get(FIRST_PARTITIONS, None)
    wanted = rows // ROWS_A_PARTITION
    if set_to == _first_partitions.get(app) and wanted > int(set_to or spark.conf.get("spark.sql.shuffle.partitions")):
        _first_partitions[app] = str(wanted)
        spark.conf.set(FIRST_PARTITIONS, wanted)


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage so that lost executors do not force a recompute from the sources. A cluster
    needs the shared folder; without one this is an error.
    """
    spark = df.sparkSession
    sized(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Evaluate a parameter table once and keep it as a literal relation.

    For tables whose size the caller knows; more than ``max_rows`` rows is an error. A pinned
    table has an exactly known size, so Catalyst broadcasts it without a hint.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a parameter table has more than {max_rows} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)
