"""Tables stored by a key: joined without a shuffle, or looked up in one file of many."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keepline.sources.artefacts import load_params, save_params

BUCKETS = 64


def _name(path: str) -> str:
    return f"keyed_{hashlib.md5(path.encode()).hexdigest()}"


def store_keyed(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``rows`` afresh in buckets by ``key``, one sorted file each, and read them back.

    Tables of the same key type and number of buckets are joined, and grouped by key, without an exchange:
    the rows are shuffled once, here. A key of very many rows makes one large file; for such tables use a
    plain one, whose joins adaptive execution can split. Null keys are stored and match nothing.
    """
    spark, name = rows.sparkSession, _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = rows.repartition(buckets, F.col(f"`{key}`"))
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    spec = spark.createDataFrame([(key, buckets, rows.schema.json())], "key string, buckets int, columns string")
    save_params(spec, f"{path}/_keyed")
    return spark.table(name)


def open_keyed(spark: SparkSession, path: str) -> DataFrame:
    """A table of `store_keyed`, in any session: its buckets are told to Spark again where they are not known."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        try:
            spec = load_params(spark, f"{path}/_keyed").first()
        except AnalysisException:
            raise FileNotFoundError(f"no table stored by key at {path}") from None
        fields = StructType.fromJson(json.loads(spec["columns"])).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{spec['key']}`) SORTED BY (`{spec['key']}`) "
            f"INTO {spec['buckets']} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def store_ranges(rows: DataFrame, path: str, key: str, files: int = BUCKETS) -> None:
    """Write ``rows`` afresh in ranges of ``key``, one sorted file each, with a Bloom filter on the key.

    A small table beside them has the least and greatest key of each file. All rows of a key are in one file.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(files, F.col(f"`{key}`")).sortWithinPartitions(f"`{key}`")
    ranged.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    k = F.col(f"`{key}`")
    ranges = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(k).alias("least"), F.max(k).alias("greatest"), F.count(F.lit(1)).alias("n")
    )
    save_params(ranges, f"{path}/_ranges")


def look_up(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of one key: the ranges name the file, and within it statistics and the Bloom filter the pages.

    Only files whose range holds the value are opened; no file, no rows.
    """
    ranges = load_params(spark, f"{path}/_ranges")
    files = ranges.where(F.lit(value).between(F.col("least"), F.col("greatest"))).select("file").collect()
    if not files:
        return spark.read.parquet(path).where(F.lit(False))
    return spark.read.parquet(*[f"{path}/{r['file']}" for r in files]).where(F.col(f"`{key}`") == F.lit(value))
