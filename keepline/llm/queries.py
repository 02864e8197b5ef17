"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepline.llm import (
    chat,
    class_model,
    collocations,
    decontaminate,
    html_text,
    line_dedup,
    packing,
    private,
    quality,
    simhash,
    spelling,
    suffixes,
    token_counts,
)
from keepline.llm.common import read
from keepline.llm.sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return done.select("original.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return done.select(
        "original.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    done = chat.format_chats(turns.unionByName(own))
    back = done.select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("mask")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )


@query
def op8_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = private.find_private(read(spark, sf_dir, "documents"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,share:double>>)")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{kind}")
        for i, kind in enumerate(private.KINDS[:4])
    ]
    return done.select(
        "doc_id",
        *counts,
        F.sha2(private.span_list(F.col("base"), none), 256).alias("base_sha256"),
        private.span_list(F.col("base"), F.col("terms")).alias("spans"),
    )


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.repeated_spans(read(spark, sf_dir, "documents"))
    sizes = F.transform("spans", lambda s: (s["end"] - s["start"]).cast("long"))
    return done.select(
        "doc_id",
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
    )


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.read_ranks(token_counts.VOCABULARY)
    return token_counts.token_counts(read(spark, sf_dir, "documents"), pieces)


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query
def op13_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model.score_texts(read(spark, sf_dir, "documents"))


__all__ = ["QUERIES", "SQL"]
