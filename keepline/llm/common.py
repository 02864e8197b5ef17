"""Helpers that the text operators share: shared tables, ASCII folding, words, safe names."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.session import shared_dir

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every node reaches (spark.checkpoint.dir); on a local master without one, a temporary
    folder that goes when the session ends."""
    folder = shared_dir(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that every node reaches")
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the quick way, which does the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once per row: lambdas inside `use` then don't repeat it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def same_partitions(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of equal columns in one partition and next to each other."""
    return df.repartition(*[F.col(c) for c in columns]).sortWithinPartitions(*columns)


def head_of(counts: DataFrame, n: str, most: int) -> tuple[DataFrame, int]:
    """The rows with the largest `n` (1 or more), and how many: whole classes of close n, `most` rows at most.

    The classes are eighths of a power of two, so the driver gets some hundred numbers whatever the rows.
    """
    close = F.floor(F.log2(n) * 8)
    tally = sorted(counts.groupBy(close.alias("close")).count().collect(), reverse=True)
    rows, cut = 0, None
    for r in tally:
        if rows + r["count"] > most:
            break
        rows, cut = rows + r["count"], r["close"]
    return counts.where(close >= cut if cut is not None else F.lit(False)), rows
