from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keepline.operators.clean import latest_per_key
from keepline.operators.split import (
    classes_of, fold_sizes, key_hash, split_summary, stratified_folds, stratified_split, test_quotas as quotas_of,
)


def table(spark, n=5000, parts=4):
    label = F.when(F.col("id") % 10 < 3, F.lit(1)).otherwise(F.lit(0))
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("k"), F.col("id")).alias("key"), label.alias("y"))


def sides(df):
    return {r["key"]: r["split"] for r in df.collect()}


def test_quotas_are_exact(spark):
    for n in (1, 7, 101, 5000):
        split = stratified_split(table(spark, n), "key", "y", 0.2, 42)
        got = Counter((r["y"], r["split"]) for r in split.collect())
        want = quotas_of(classes_of(table(spark, n), "y"), 0.2)
        assert {y: got[(y, "test")] for y in want} == want
        assert sum(want.values()) == math.ceil(0.2 * n)
        assert sum(got.values()) == n


def test_split_does_not_depend_on_layout(spark):
    first = sides(stratified_split(table(spark), "key", "y"))
    again = sides(stratified_split(table(spark, parts=1).orderBy(F.desc("key")), "key", "y"))
    coarse = sides(stratified_split(table(spark).repartition(7), "key", "y", digits=1))
    assert first == again == coarse
    assert sides(stratified_split(table(spark), "key", "y", seed=43)) != first


def test_split_follows_hash_order(spark):
    rows = stratified_split(table(spark), "key", "y").withColumn("h", key_hash(F.col("key"), 42)).collect()
    for y in (0, 1):
        order = [r["split"] for r in sorted((r for r in rows if r["y"] == y), key=lambda r: (r["h"], r["key"]))]
        assert order == sorted(order)


def test_no_wide_shuffle(spark):
    """The sides are assigned by constants: the plan of the result has no exchange."""
    split = stratified_split(table(spark), "key", "y")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rows_of_one_key_stay_together(spark):
    hot = spark.range(3000).select(F.lit("hot").alias("key"), F.lit(1).alias("y"))
    both = table(spark, 6000).unionByName(hot)
    split = stratified_split(both, "key", "y")
    assert split.count() == 9000
    assert split.groupBy("key").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_folds(spark):
    k = 5
    folds = stratified_folds(table(spark, 4998), "key", "y", k)
    got = Counter((r["y"], r["fold"]) for r in folds.collect())
    for y in (0, 1):
        sizes = [got[(y, f)] for f in range(k)]
        assert max(sizes) - min(sizes) <= 1
    overall = [sum(got[(y, f)] for y in (0, 1)) for f in range(k)]
    assert sum(overall) == 4998 and max(overall) - min(overall) <= 1


def test_fold_sizes_match_dealing():
    for classes in ([("a", 3), ("b", 11)], [("a", 1), ("b", 1), ("c", 2)], [("a", 0), ("b", 9)]):
        dealt = [y for y, n in classes for _ in range(n)]
        for k in (2, 3, 5):
            want = {y: [sum(1 for i in range(f, len(dealt), k) if dealt[i] == y) for f in range(k)] for y, _ in classes}
            assert fold_sizes(classes, k) == want


def test_small_classes_and_nulls(spark):
    rows = spark.createDataFrame(
        [("a", "x"), ("b", "x"), ("c", None), ("d", None), ("e", "z")], "key string, y string"
    )
    assert stratified_folds(rows, "key", "y", 3).where("fold is null").count() == 0
    split = stratified_split(rows, "key", "y", 0.4)
    assert Counter(r["split"] for r in split.collect()) == {"test": 2, "train": 3}
    empty = rows.where("key = 'none'")
    assert stratified_split(empty, "key", "y").count() == 0
    assert stratified_folds(empty, "key", "y").count() == 0


def test_too_many_classes(spark):
    with pytest.raises(ValueError):
        classes_of(spark.range(2000), "id")


def test_summary(spark):
    got = {r["split"]: r for r in split_summary(stratified_split(table(spark), "key", "y"), "y", 9).collect()}
    assert got["test"]["n_rows"] == 1000 and got["train"]["n_features"] == 9
    assert abs(got["test"]["positive_rate"] - 0.3) < 1e-9


def test_null_keys_and_too_many_ranges_are_errors(spark):
    rows = spark.createDataFrame([("a", 1), (None, 1), ("b", 0)], "key string, y int")
    with pytest.raises(ValueError, match="null"):
        stratified_split(rows, "key", "y")
    with pytest.raises(ValueError, match="ranges"):
        stratified_split(rows.where("key is not null"), "key", "y", digits=6)


def test_repeated_keys_stay_together_and_can_be_reduced_first(spark):
    rows = spark.createDataFrame([("hot", 1, i) for i in range(12)] + [(f"k{i}", 1, 0) for i in range(8)], "key string, y int, at int")
    split = stratified_split(rows, "key", "y")
    assert split.where("key = 'hot'").select("split").distinct().count() == 1
    single = latest_per_key(rows, ["key"], ["at"])
    assert single.columns == rows.columns
    assert single.where("key = 'hot'").first()["at"] == 11
    sides = {r["split"]: r["count"] for r in stratified_split(single, "key", "y").groupBy("split").count().collect()}
    assert sides == {"train": 7, "test": 2}
