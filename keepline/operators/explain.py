"""Why a customer scored as they did.

Attributions travel as ``contributions``: an array of (feature, contribution) in feature
order, so ranking a customer's reasons happens inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepline.functions.numbers import round_exact
from keepline.functions.text import lookup
from keepline.operators.score import linear_margin, read_coefficients
from keepline.roles import REASON_LABELS, SUPPORT_HINT_FEATURES
from keepline.session import pin


def feature_means(df: DataFrame, features: list[str]) -> DataFrame:
    """One-row table of feature means: the background of a linear attribution."""
    return pin(df.agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f) for f in features]), 1)


def linear_contributions(
    df: DataFrame, coefficients: DataFrame, means: DataFrame, out: str = "contributions"
) -> DataFrame:
    """weight * (x - mean) per feature; these are the linear model's exact Shapley values.

    ``base_value`` is the margin at the means, so base + sum of contributions = margin.
    """
    weights, intercept = read_coefficients(coefficients)
    mean = means.first().asDict()
    parts = [
        F.struct(
            F.lit(f).alias("feature"),
            (F.lit(w) * (F.col(f"`{f}`").cast("double") - F.lit(mean[f]))).alias("contribution"),
        )
        for f, w in weights.items()
    ]
    base = intercept + sum(w * mean[f] for f, w in weights.items())
    return df.withColumns({out: F.array(*parts), "base_value": F.lit(base)})


def linear_margins(df: DataFrame, coefficients: DataFrame, out: str = "margin") -> DataFrame:
    return df.withColumn(out, linear_margin(*read_coefficients(coefficients)))


def _first(contributions: Column, n: int, value, descending: bool) -> Column:
    """The first ``n`` entries by value; equal values keep feature order."""
    sign = -1 if descending else 1
    keyed = F.transform(
        contributions,
        lambda c, i: F.struct(
            value(c["contribution"]).alias("v"),
            (i * sign).alias("i"),
            c["feature"].alias("feature"),
            c["contribution"].alias("contribution"),
        ),
    )
    return F.transform(
        F.slice(F.sort_array(keyed, asc=not descending), 1, n),
        lambda s: F.struct(s["feature"].alias("feature"), s["contribution"].alias("contribution")),
    )


def top_contributions(contributions: Column, n: int = 5) -> Column:
    """The ``n`` largest, towards churn; they may be negative when few push that way."""
    return _first(contributions, n, lambda v: v, True)


def bottom_contributions(contributions: Column, n: int = 3) -> Column:
    """The ``n`` smallest, towards staying."""
    return _first(contributions, n, lambda v: v, False)


def largest_contributions(contributions: Column, n: int = 12) -> Column:
    """The ``n`` largest by size, either direction."""
    return _first(contributions, n, F.abs, True)


def total_contribution(contributions: Column) -> Column:
    return F.aggregate(contributions, F.lit(0.0), lambda s, c: s + c["contribution"])


def reason_label(feature: Column) -> Column:
    """Readable reason; features without one show their name with blanks."""
    return lookup(feature, REASON_LABELS, F.translate(feature, "_", " "))


def as_map(contributions: Column) -> Column:
    return F.map_from_arrays(contributions["feature"], contributions["contribution"])


def explain(df: DataFrame, contributions: str = "contributions", positive_only: bool = False) -> DataFrame:
    """Adds top_reasons (3), top_positive (5), top_negative (3), all scores, and risk_hint."""
    arr = F.col(contributions)
    upward = F.filter(arr, lambda c: c["contribution"] > 0) if positive_only else arr
    top = top_contributions(upward, 5)
    return df.withColumns(
        {
            "_top": top,
            "_bottom": bottom_contributions(arr, 3),
        }
    ).withColumns(
        {
            "top_reasons": F.transform(
                F.slice("_top", 1, 3),
                lambda c: F.struct(
                    c["feature"].alias("feature"),
                    round_exact(c["contribution"], 4).alias("shap_value"),
                    reason_label(c["feature"]).alias("reason"),
                ),
            ),
            "top_positive": as_map(F.col("_top")),
            "top_negative": as_map(F.col("_bottom")),
            "shap_scores": as_map(arr),
            "risk_hint": risk_hint(arr),
        }
    ).drop("_top", "_bottom")


def risk_hint(contributions: Column) -> Column:
    """The explainer's own guess: support_issue when a support feature pushes towards churn."""
    pushes = F.exists(
        contributions,
        lambda c: c["feature"].isin(*SUPPORT_HINT_FEATURES) & (c["contribution"] > 0),
    )
    return F.when(pushes, F.lit("support_issue")).otherwise(F.lit("disengagement"))


def _long(df: DataFrame, contributions: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(contributions).alias("ordinal", "c")).select(
        *keep,
        (F.col("ordinal") + 1).alias("ordinal"),
        F.col("c.feature").alias("feature"),
        F.col("c.contribution").alias("contribution"),
    )


def global_importance(df: DataFrame, contributions: str = "contributions", n: int = 15) -> DataFrame:
    """Mean size of the contribution per feature, the ``n`` largest.

    Exploded rows meet a map-side aggregate, so what is shuffled is one row per feature and task.
    """
    return (
        _long(df, contributions)
        .groupBy("feature", "ordinal")
        .agg(F.avg(F.abs("contribution")).alias("mean_abs"))
        .orderBy(F.desc("mean_abs"), "ordinal")
        .limit(n)
    )


def contribution_grid(
    df: DataFrame,
    features: list[str],
    contributions: str = "contributions",
    value_bins: int = 10,
    contribution_bins: int = 20,
    n: int = 20,
) -> DataFrame:
    """Distribution per feature: counts on a grid of feature value by contribution.

    Stands for the point swarm: same information at chart resolution, small for any input size.
    ``features`` lists the columns in the order of the contributions. The value ranges, one row
    per feature, become constants; rows are exploded to three small integers and counted.
    """
    points = [
        F.struct(
            F.lit(i).alias("i"),
            F.col(f"`{f}`").cast("double").alias("x"),
            F.get(contributions, F.lit(i))["contribution"].alias("y"),
        )
        for i, f in enumerate(features)
    ]
    ranges = (
        df.select(F.inline(F.array(*points)))
        .groupBy("i")
        .agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"),
            F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.avg(F.abs("y")).alias("mean_abs"),
        )
        .orderBy(F.desc("mean_abs"), "i")
        .limit(n)
        .collect()
    )

    def cell(v: Column, lo: float | None, hi: float | None, bins: int) -> Column:
        if lo is None or lo == hi:
            return F.when(v.isNotNull(), F.lit(0))
        return F.least(F.floor((v - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int")

    cells = [
        F.struct(
            F.lit(features[r["i"]]).alias("feature"),
            cell(points[r["i"]]["x"], r["x0"], r["x1"], value_bins).alias("value_bin"),
            cell(points[r["i"]]["y"], r["y0"], r["y1"], contribution_bins).alias("contribution_bin"),
        )
        for r in ranges
    ]
    if not cells:
        empty = "feature string, value_bin int, contribution_bin int, n bigint"
        return df.sparkSession.createDataFrame([], empty)
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("feature", "value_bin", "contribution_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def waterfall(df: DataFrame, key: str, key_value, contributions: str = "contributions", n: int = 12) -> DataFrame:
    """One customer from base value to margin: the ``n`` largest steps, then the rest.

    The key filter comes first, so attribution is computed for that customer only.
    """
    one = df.where(F.col(key) == F.lit(key_value))
    top = largest_contributions(F.col(contributions), n)
    rest = total_contribution(F.col(contributions)) - total_contribution(top)
    base = F.array(F.struct(F.lit("(base)").alias("feature"), F.col("base_value").alias("contribution")))
    others = F.array(F.struct(F.lit("(other)").alias("feature"), rest.alias("contribution")))
    margin = F.array(
        F.struct(
            F.lit("(margin)").alias("feature"),
            (F.col("base_value") + total_contribution(F.col(contributions))).alias("contribution"),
        )
    )
    return one.select(key, F.posexplode(F.concat(base, top, others, margin)).alias("step", "s")).select(
        key, "step", F.col("s.feature").alias("feature"), F.col("s.contribution").alias("contribution")
    )


def dependence(df: DataFrame, feature: str, color: str, contributions: str = "contributions") -> DataFrame:
    """Contribution against value of one feature, with a second feature as colour."""
    mine = F.filter(F.col(contributions), lambda c: c["feature"] == feature)
    return df.select(
        F.col(f"`{feature}`").alias("value"),
        F.get(mine, F.lit(0))["contribution"].alias("contribution"),
        F.col(f"`{color}`").alias("color"),
    )


def dependence_curve(points: DataFrame, width: float = 1.0) -> DataFrame:
    """The same, averaged per bin of the value."""
    return points.groupBy(F.floor(F.col("value") / width).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("contribution").alias("avg_contribution"),
        F.avg("color").alias("avg_color"),
    )


def customer_features(
    df: DataFrame, key: str, key_value, features: list[str], contributions: str = "contributions", n: int = 20
) -> DataFrame:
    """One customer's features with value and contribution, largest contributions first."""
    values = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    one = df.where(F.col(key) == F.lit(key_value)).select(key, F.inline(
        F.transform(
            F.arrays_zip(F.col(contributions).alias("c"), values.alias("x")),
            lambda z: F.struct(
                z["c"]["feature"].alias("feature"),
                z["x"].alias("value"),
                z["c"]["contribution"].alias("contribution"),
            ),
        )
    ))
    return one.orderBy(F.abs("contribution").desc(), "feature").limit(n)


def extreme_customers(df: DataFrame, key: str, label: str, contributions: str = "contributions") -> DataFrame:
    """The churner with the largest and the stayer with the smallest total contribution."""
    total = total_contribution(F.col(contributions))
    rows = df.select(key, F.col(label).alias("y"), total.alias("total"))
    picked = rows.agg(
        F.min(F.when(F.col("y") == 1, F.struct((-F.col("total")).alias("t"), F.col(key)))).alias("hi"),
        F.min(F.when(F.col("y") == 0, F.struct(F.col("total").alias("t"), F.col(key)))).alias("lo"),
    )
    return picked.select(
        F.inline(
            F.array(
                F.struct(F.lit("high_risk").alias("kind"), F.col(f"hi.{key}").alias(key), (-F.col("hi.t")).alias("total")),
                F.struct(F.lit("low_risk").alias("kind"), F.col(f"lo.{key}").alias(key), F.col("lo.t").alias("total")),
            )
        )
    )


def representative_customers(
    df: DataFrame, key: str, label: str, prob: str, middle: float = 0.70
) -> DataFrame:
    """Highest-scored churner, lowest score overall, churner nearest to ``middle``."""
    churner = F.col(label) == 1
    picked = df.agg(
        F.min(F.when(churner, F.struct((-F.col(prob)).alias("o"), F.col(key), F.col(prob)))).alias("high"),
        F.min(F.struct(F.col(prob).alias("o"), F.col(key), F.col(prob))).alias("low"),
        F.min(
            F.when(churner, F.struct(F.abs(F.col(prob) - middle).alias("o"), F.col(key), F.col(prob)))
        ).alias("mid"),
    )
    rows = [
        F.struct(F.lit(k).alias("kind"), F.col(f"{k}.{key}").alias(key), F.col(f"{k}.{prob}").alias(prob))
        for k in ("high", "low", "mid")
    ]
    return picked.select(F.inline(F.array(*rows)))
