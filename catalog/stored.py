"""Tables stored by key, profiles of batches, answers in several goes: the same rows as without."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEY, LABEL, decisions, explained, features, prepared, scored, snapshots, texts
from catalog.columns import risk
from catalog.figures import _RATED, _names, _sql_names, rounded
from catalog.registry import SQL, query
from catalog.sql import RAW, sql
from catalog.tables import _KINDS
from keepline.operators.batches import add_batch, profile_of, rates_of
from keepline.operators.explain import largest_contributions, waterfall
from keepline.operators.messages import message_prompts
from keepline.plans.marts import customer_detail, customer_join
from keepline.session import new_path
from keepline.sources.answers import answer
from keepline.sources.keyed import look_up, store_keyed, store_ranges

BATCHES = 3


def _batches(spark, sf) -> str:
    """The customers' profiles, added batch by batch."""
    path, rows = new_path(spark, "batches"), features(spark, sf)
    for i in range(BATCHES):
        add_batch(rows.where(F.col("customer_no") % BATCHES == i), path, f"b{i}", _RATED, LABEL)
    return path


_NUMBER = {c for c, t in _KINDS.items() if t != "string"} | {"TotalCharges"}


def _row(c: str) -> str:
    kind = "double" if c == "TotalCharges" else _KINDS[c]  # parsed in the feature table
    numbers = [f"{f}({c})" for f in ("min", "max", "avg")] if c in _NUMBER else ["NULL"] * 3
    least, greatest, mean = (f"CAST({x} AS DOUBLE)" for x in numbers)
    return (
        f"SELECT '{c}' AS column_name, '{kind}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS nulls, "
        f"{least} AS least, {greatest} AS greatest, round({mean}, 6) AS mean FROM feat"
    )


@query("a02_merged_profile", sql(" UNION ALL ".join(_row(c) for c in RAW)))
def _(spark, sf):
    merged = profile_of(spark, _batches(spark, sf)).where(F.col("column_name").isin(list(RAW)))
    return rounded(merged.select("column_name", "dtype", "n_rows", "nulls", "least", "greatest", "mean"), "mean")


@query("e02_merged_rates", SQL["e02_rate_by"])
def _(spark, sf):
    return rounded(rates_of(spark, _batches(spark, sf)), "rate", digits=9)


@query("d01_stored_join", SQL["d01_customer_join"])
def _(spark, sf):
    parts = [
        prepared(spark, sf).features.select(KEY, LABEL, "split"),
        scored(spark, sf).select(KEY, "churn_prob", "active_services"),
        snapshots(spark, sf).select(KEY, "gender", "Contract"),
    ]
    return customer_join(*[store_keyed(p, new_path(spark, "keyed"), KEY, 16) for p in parts], KEY)


@query("b15_stored_lookup", SQL["b15_customer_detail"])
def _(spark, sf):
    path = new_path(spark, "ranges")
    store_ranges(risk(spark, sf), path, KEY, 16)
    return customer_detail(look_up(spark, path, KEY, "7|1998-04-01"), KEY, "7|1998-04-01")


@query("i10_resumed_answers", SQL["i10_generate"])
def _(spark, sf):
    """Half the prompts are answered in a first go, the rest in a second."""
    prompts, path = message_prompts(decisions(spark, sf), KEY, texts(spark, sf)), new_path(spark, "answers")

    def make_writer():
        return lambda prompt: f"Subject: {len(prompt)} characters\n\n{prompt}"

    answer(prompts.where(F.xxhash64(KEY) % 2 == 0), KEY, path, make_writer, tasks=8)
    return answer(prompts, KEY, path, make_writer, tasks=8)


@query("f06_largest_five", sql(f"SELECT customerID, {_sql_names('biggest', 5)} AS features FROM topped"))
def _(spark, sf):
    return explained(spark, sf).select(KEY, _names(largest_contributions(F.col("contributions"), 5)).alias("features"))


@query(
    "h05_waterfall_five",
    sql(
        """, one AS (SELECT * FROM topped WHERE customerID = '7|1998-04-01'),
        s AS (SELECT customerID, unnest(range(1, 6)) AS step, unnest(biggest[1:5]) AS b FROM one),
        t AS (SELECT list_sum(list_transform(contributions, lambda x: x.c)) AS total,
              list_sum(list_transform(biggest[1:5], lambda x: x.c)) AS shown FROM one)
        SELECT customerID, CAST(step AS INTEGER) AS step, b.f AS feature, round(b.c, 6) AS contribution FROM s
        UNION ALL SELECT customerID, 0, '(base)', base_value FROM one
        UNION ALL SELECT customerID, 6, '(other)', round(total - shown, 6) FROM one, t
        UNION ALL SELECT customerID, 7, '(margin)', round(base_value + total, 6) FROM one, t"""
    ),
)
def _(spark, sf):
    return rounded(waterfall(explained(spark, sf), KEY, "7|1998-04-01", n=5), "contribution")
