"""From raw documents to packed training sequences, stage by stage.

Each stage works on what the one before has kept; all but the last return the columns of documents,
and any others that the rows have. Stages that judge whole documents do so by id: rows that share an
id, or have none, stay if any of them stays. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepline.llm import decontaminate, line_dedup, packing, quality, simhash
from keepline.llm.common import read, stored


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in `ids`; the columns of docs, whatever their names."""
    ids = ids.select(F.col("doc_id").alias("kept_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules or the forest reject."""
    judged = quality.quality_rules(docs, read(spark, sf_dir, "labels"))
    return _only(docs, judged.where("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document; n_chars follows the text."""
    done = line_dedup.dedup_lines(docs)
    own = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return done.select(*[own.get(c, F.col("original").getField(c)).alias(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    groups = simhash.simhash_groups(docs)
    return _only(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents contaminated by the benchmark."""
    done = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return done.where(~F.col("contaminated")).select("original.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The forest, fingerprints and packing are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read by the next stage."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
