"""Tables by key, lookups, profiles of batches, answers that survive a lost job."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keepline.operators.batches import add_batch, profile_of, rates_of, summarise
from keepline.operators.eda import rate_by
from keepline.plans.marts import customer_join
from keepline.sources.answers import _asker, answer, read_answers
from keepline.sources.keyed import look_up, open_keyed, store_keyed, store_ranges


def people(spark, n: int = 5000):
    return spark.range(n).select(
        F.concat(F.lit("c"), F.col("id")).alias("key"), (F.col("id") % 97).alias("a"), (F.rand(3) * 100).alias("b")
    )


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_stored_tables_have_no_exchange(spark, tmp_path, no_broadcast):
    rows = people(spark)
    parts = [rows.select("key", "a"), rows.where("a < 50").select("key", "b"), rows.select("key", F.lit("x").alias("c"))]
    stored = [store_keyed(p, str(tmp_path / f"t{i}"), "key", 16) for i, p in enumerate(parts)]
    plain = customer_join(*parts, "key")
    joined = customer_join(*stored, "key")
    assert plan(plain).count("Exchange") >= 3
    assert "Exchange" not in plan(joined) and "Exchange" not in plan(joined.groupBy("key").count())
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_a_stored_table_opens_again(spark, tmp_path, no_broadcast):
    path = str(tmp_path / "t")
    first = store_keyed(people(spark), path, "key", 8)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) == 8
    for r in spark.sql("SHOW TABLES").where(F.col("tableName").startswith("keyed_")).collect():
        spark.sql(f"DROP TABLE {r['tableName']}")
    again = open_keyed(spark, path)
    assert again.schema == first.schema and again.count() == 5000
    assert "Exchange" not in plan(again.join(again.select("key", F.col("a").alias("z")), "key"))
    store_keyed(people(spark, 10), path, "key", 4)  # afresh, with other buckets
    assert open_keyed(spark, path).count() == 10
    empty = store_keyed(people(spark, 0), str(tmp_path / "none"), "key", 4)
    assert empty.count() == 0
    with pytest.raises(FileNotFoundError):
        open_keyed(spark, str(tmp_path / "nowhere"))


def test_a_lookup_opens_one_file_of_many(spark, tmp_path):
    path = str(tmp_path / "r")
    store_ranges(people(spark), path, "key", 20)
    assert spark.read.parquet(f"{path}/_ranges").agg(F.sum("n")).first()[0] == 5000
    for k in ("c0", "c999", "c4321"):
        got = look_up(spark, path, "key", k)
        assert len(got.inputFiles()) == 1
        assert [r["a"] for r in got.collect()] == [int(k[1:]) % 97]
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 20
    assert look_up(spark, path, "key", "c10x").count() == 0
    assert look_up(spark, path, "key", "zzz").count() == 0 and look_up(spark, path, "key", "zzz").columns == ["key", "a", "b"]


def test_profiles_of_batches_merge(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 30_000
    data = pd.DataFrame({
        "k": np.arange(n), "x": rng.lognormal(size=n), "g": rng.choice(list("pqrs"), n), "y": rng.integers(0, 2, n),
    })
    data.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(data, "k long, x double, g string, y int").withColumn("x", F.when(F.col("k") % 11 != 0, F.col("x")))
    path = str(tmp_path / "p")
    for i, (a, b) in enumerate([(0, 17), (17, 9000), (9000, 9000), (9000, n)]):  # one batch is empty
        add_batch(df.where((F.col("k") >= a) & (F.col("k") < b)), path, f"b{i}", ["g"], "y")
    add_batch(df.where("k >= 9000"), path, "b3", ["g"], "y")  # again: replaced, not doubled
    got = {r["column_name"]: r for r in profile_of(spark, path).collect()}
    good = data.x[(data.k % 11 != 0)].dropna()
    assert got["x"]["n_rows"] == n and got["x"]["nulls"] == n - len(good)
    assert got["x"]["least"] == good.min() and got["x"]["greatest"] == good.max()
    assert abs(got["x"]["mean"] - good.mean()) < 1e-9
    for q in (25, 50, 75):
        assert abs((good <= got["x"][f"q{q}"]).mean() - q / 100) < 0.02
    assert abs(got["k"]["distinct"] / n - 1) < 0.06 and got["g"]["distinct"] == 4 and got["y"]["distinct"] == 2
    assert got["g"]["mean"] is None and got["g"]["q50"] is None
    key = lambda r: (r["feature"], str(r["level"]))
    whole, merged = (sorted(t.collect(), key=key) for t in (rate_by(df, ["g"], "y"), rates_of(spark, path)))
    assert [(r["feature"], r["level"], r["n"]) for r in whole] == [(r["feature"], r["level"], r["n"]) for r in merged]
    assert all(abs(a["rate"] - b["rate"]) < 1e-12 for a, b in zip(whole, merged))
    assert summarise(df.where("false")).count() == 4


def test_a_lost_job_asks_no_prompt_twice(spark, tmp_path):
    path, asked, broken = str(tmp_path / "answers"), str(tmp_path / "asked"), str(tmp_path / "broken")
    os.makedirs(asked)
    prompts = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("p"), F.col("id")).alias("prompt"))

    def make_writer():
        def write(prompt: str) -> str:
            if os.path.exists(broken) and len(os.listdir(asked)) >= 60:
                raise RuntimeError("the service is gone")
            with open(f"{asked}/{prompt}", "x"):  # an error if it is there: a prompt asked twice
                return f"to {prompt}"

        return write

    open(broken, "w").close()
    with pytest.raises(Exception, match="the service is gone"):
        answer(prompts, "k", path, make_writer, tasks=4)
    kept = read_answers(spark, path, "k", "long").count()
    assert 60 <= kept < 200 and kept == len(os.listdir(asked))
    with open(f"{path}/task-cut-0.json", "w") as f:
        f.write('{"k": 3, "te')  # cut off in the middle
    os.rename(broken, f"{broken}-no-more")
    done = {r["k"]: r["text"] for r in answer(prompts, "k", path, make_writer, tasks=4).collect()}
    assert done == {i: f"to p{i}" for i in range(200)}
    assert answer(prompts, "k", path, make_writer, tasks=4).count() == 200
    assert read_answers(spark, str(tmp_path / "none"), "k", "long").count() == 0


def test_another_attempt_of_a_task_goes_on(tmp_path):
    asked = []

    def make_writer():
        def write(prompt: str) -> str:
            if prompt == "p5" and "p5" not in asked:
                asked.append("p5")
                raise RuntimeError("lost")
            asked.append(prompt)
            return prompt.upper()

        return write

    ask = _asker(str(tmp_path / "a"), "k", "text", make_writer)
    batches = [pd.DataFrame({"k": range(i, i + 4), "prompt": [f"p{j}" for j in range(i, i + 4)]}) for i in (0, 4)]
    with pytest.raises(RuntimeError):
        list(ask(iter(batches), "r-0", 1))
    assert [int(b["asked"].iloc[0]) for b in ask(iter(batches), "r-0", 2)] == [0, 3]
    assert asked == ["p0", "p1", "p2", "p3", "p4", "p5", "p5", "p6", "p7"]
