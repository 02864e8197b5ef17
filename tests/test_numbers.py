from __future__ import annotations

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keepline.functions.numbers import (
    fixed_text, parse_number, percent_text, round_exact, round_scaled, safe_divide, signed_text,
)
from keepline.functions.text import lookup, strip
from keepline.operators.ranks import exact_median, value_totals


def values(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, x {kind}")


def test_rounding_follows_the_stored_value(spark):
    rng = np.random.default_rng(3)
    xs = [2.675, 4.525, 0.125, 62.5, 63.5, -2.675, 1.005, 1e-7, 0.0]
    xs += [float(v) for v in np.round(rng.uniform(-5000, 5000, 3000), 3)]
    xs += [float(v) for v in rng.uniform(-1, 1, 1000)]
    df = values(spark, xs).select(
        "i",
        round_exact(F.col("x"), 2).alias("r2"),
        round_exact(F.col("x"), 4).alias("r4"),
        fixed_text(F.col("x"), 0).alias("t0"),
        round_scaled(F.col("x"), 1).alias("n1"),
        percent_text(F.col("x"), 1).alias("p1"),
        signed_text(F.col("x"), 3).alias("s3"),
    )
    for r in df.collect():
        x = xs[r["i"]]
        assert r["r2"] == round(x, 2) and r["r4"] == round(x, 4)
        assert float(r["t0"]) == float(f"{x:.0f}")
        assert r["n1"] == float(np.round(x, 1))
        assert float(r["p1"].rstrip("%")) == float(f"{x * 100.0:.1f}")
        assert float(r["s3"]) == float(f"{x:+.3f}") and (x == 0 or r["s3"][0] in "+-")


def test_parse_number(spark):
    cases = {
        "": None, " ": None, "1.0d": None, "abc": None, " 12 ": 12.0, "\t-3.5\n": -3.5, "1e3": 1000.0,
        ".5": 0.5, "5.": 5.0, "1,000": None, "0x10": None, "+7": 7.0, "1.2.3": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, want double")
    for r in rows.withColumn("got", parse_number(F.col("t"))).collect():
        assert r["got"] == r["want"], r
    nothing = spark.createDataFrame([(None,)], "t string").select(parse_number(F.col("t")).alias("x"))
    assert nothing.first()["x"] is None


def test_strip_matches_python(spark):
    odd = ["  a b　", "\x1f x \x1c", " line ", "", " \t\r\n", "​kept​"]
    rows = values(spark, odd, "string").withColumn("s", strip(F.col("x")))
    assert [r["s"] for r in rows.orderBy("i").collect()] == [v.strip() for v in odd]


def test_lookup_and_divide(spark):
    rows = values(spark, ["a", "b", None], "string").select(
        "i", lookup(F.col("x"), {"a": 1}, F.lit(0)).alias("v"), lookup(F.col("x"), {"a": 1}).alias("w")
    )
    assert [(r["v"], r["w"]) for r in rows.orderBy("i").collect()] == [(1, 1), (0, None), (0, None)]
    one = spark.range(1).select(safe_divide(F.lit(1), F.lit(0)).alias("a"), safe_divide(F.lit(1), F.lit(4)).alias("b")).first()
    assert (one["a"], one["b"]) == (0.0, 0.25)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-20, 20).map(float), st.floats(-1e6, 1e6)), max_size=60))
def test_median_is_exact(spark, xs):
    got = exact_median(values(spark, xs), "x", buckets=8)
    known = [x for x in xs if x is not None]
    want = float(np.median(known)) if known else None
    assert got == want or math.isclose(got, want, rel_tol=1e-15)


def test_running_totals_with_a_hot_value(spark):
    rng = np.random.default_rng(5)
    xs = [7.0] * 2000 + [float(v) for v in rng.integers(0, 500, 4000)] + [float(v) for v in rng.normal(size=500)]
    got = value_totals(values(spark, xs), "x", {"n": F.lit(1).cast("long")}, buckets=16).orderBy("x").collect()
    uniq, counts = np.unique(xs, return_counts=True)
    assert [r["x"] for r in got] == list(uniq)
    assert [r["n"] for r in got] == list(counts)
    assert [r["cum_n"] for r in got] == list(np.cumsum(counts))
