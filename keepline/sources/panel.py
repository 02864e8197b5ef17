"""Customer snapshots from an order history.

One row per customer and quarter start: what was known in the trailing year, and whether the
customer stayed away in the following nine months. No later data enters the features.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepline.session import shuffled

FIRST_SNAPSHOT = dt.date(1996, 1, 1)
LAST_SNAPSHOT = dt.date(2000, 10, 1)
WINDOW_DAYS = 365
HORIZON_DAYS = 270

# First word of a part type -> bit in the per-order mask.
PART_BITS = {"STANDARD": 1, "ECONOMY": 2, "MEDIUM": 4, "SMALL": 8, "LARGE": 16, "PROMO": 32}
RETURNED_BIT = 64
URGENT_BIT = 128

CONTRACT_BY_SEGMENT = {
    "AUTOMOBILE": "Month-to-month", "BUILDING": "Month-to-month",
    "FURNITURE": "One year", "HOUSEHOLD": "One year", "MACHINERY": "Two year",
}


def _quarters(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last, F.expr("interval 3 months")))


def _next_quarter(day: Column) -> Column:
    return F.add_months(F.trunc(day, "quarter"), 3)


def _order_masks(lineitem: DataFrame, part: DataFrame, wanted: DataFrame) -> DataFrame:
    """What kinds of parts a wanted order holds, as one integer per order; other lines go first."""
    word = F.split_part(F.col("p_type"), F.lit(" "), F.lit(1))
    bits = F.lit(0)
    for name, bit in PART_BITS.items():
        bits = F.when(word == name, F.lit(bit)).otherwise(bits)
    kinds = part.select("p_partkey", bits.alias("kind"))
    returned = F.when(F.col("l_returnflag") == "R", F.lit(RETURNED_BIT)).otherwise(F.lit(0))
    lines = lineitem.select("l_orderkey", "l_partkey", returned.alias("returned"))
    lines = lines.join(wanted, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return (
        lines.join(kinds, F.col("l_partkey") == F.col("p_partkey"), "left")
        .groupBy("l_orderkey")
        .agg(
            F.bit_or(F.col("returned").bitwiseOR(F.coalesce("kind", F.lit(0)))).alias("mask")
        )
    )


def snapshot_panel(
    customer: DataFrame, orders: DataFrame, lineitem: DataFrame, part: DataFrame
) -> DataFrame:
    """Telco-style customer table with one row per (customer, snapshot date).

    Every order is sent to the few snapshots it belongs to and summed there, so the plan has
    equi-joins and hash aggregates only; a customer with very many orders shrinks to at most
    one row per snapshot in each map task before anything is shuffled.
    """
    first, last = F.lit(FIRST_SNAPSHOT), F.lit(LAST_SNAPSHOT)
    o = orders.withColumn("day", F.col("o_orderdate").cast("date"))

    in_window = o.where(
        (F.col("day") >= F.date_sub(first, WINDOW_DAYS)) & (F.col("day") < last)
    )
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    # One ordered number per order: days first, order key second. All aggregate buffers stay
    # fixed-width, which keeps this a hash aggregate.
    recency = F.unix_date("day").cast("decimal(10,0)") * F.lit(Decimal(10) ** 20) + F.col(
        "o_orderkey"
    ).cast("decimal(20,0)")
    activity = (
        in_window.join(
            _order_masks(lineitem, part, in_window.select("o_orderkey")), F.col("o_orderkey") == F.col("l_orderkey"), "left"
        )
        .select(
            "o_custkey",
            _quarters(_next_quarter(F.col("day")), F.date_add("day", WINDOW_DAYS)).alias("as_of"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
            F.coalesce("mask", F.lit(0))
            .bitwiseOR(F.when(priority == 1, F.lit(URGENT_BIT)).otherwise(F.lit(0)))
            .alias("mask"),
            F.col("o_orderstatus").eqNullSafe("F").cast("int").alias("f"),
            F.col("o_orderstatus").eqNullSafe("P").cast("int").alias("p"),
            F.col("o_orderstatus").eqNullSafe("O").cast("int").alias("o"),
            priority.alias("priority"),
            F.when(priority.isNotNull(), recency).alias("recency"),
            F.lit(0).alias("later"),
        )
    )
    in_horizon = o.where(
        (F.col("day") >= first) & (F.col("day") < F.date_add(last, HORIZON_DAYS))
    )
    future = in_horizon.select(
        "o_custkey",
        _quarters(
            _next_quarter(F.date_sub("day", HORIZON_DAYS)), F.trunc("day", "quarter")
        ).alias("as_of"),
        F.lit(1).alias("later"),
    )
    facts = (
        activity.unionByName(future, allowMissingColumns=True)
        .where(F.col("as_of").between(first, last))
        .groupBy("o_custkey", "as_of")
        .agg(
            F.sum("cents").alias("cents"),
            F.bit_or("mask").alias("mask"),
            F.sum("f").alias("n_f"),
            F.sum("p").alias("n_p"),
            F.sum("o").alias("n_o"),
            F.max_by("priority", "recency").alias("priority"),
            F.max("later").alias("later"),
        )
    )
    base = (
        o.where(F.col("day") < last)
        .groupBy("o_custkey")
        .agg(F.min("day").alias("first_order"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "first_order",
            _quarters(F.greatest(_next_quarter(F.col("first_order")), first), last).alias("as_of"),
        )
    )
    joined = base.join(
        facts,
        (F.col("c_custkey") == F.col("o_custkey")) & (base["as_of"] == facts["as_of"]),
        "left",
    ).drop(facts["as_of"])
    return joined.select(*_telco_columns())


def _telco_columns() -> list[Column]:
    mask = F.coalesce("mask", F.lit(0))
    cents = F.coalesce("cents", F.lit(0).cast("long"))

    def yes(cond: Column) -> Column:
        return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))

    def has(bit: int) -> Column:
        return mask.bitwiseAND(F.lit(bit)) != 0

    # NULL counts (no orders in the window) fall through to 'No'.
    internet = (
        F.when((F.col("n_f") >= F.col("n_p")) & (F.col("n_f") >= F.col("n_o")), F.lit("Fiber optic"))
        .when(F.col("n_p") >= F.col("n_o"), F.lit("DSL"))
        .otherwise(F.lit("No"))
    )

    def online(cond: Column) -> Column:
        return F.when(internet == "No", F.lit("No internet service")).otherwise(yes(cond))

    contract = F.lit(None).cast("string")
    for segment, name in CONTRACT_BY_SEGMENT.items():
        contract = F.when(F.col("c_mktsegment") == segment, F.lit(name)).otherwise(contract)
    payment = (
        F.when(F.col("priority") == 1, F.lit("Electronic check"))
        .when((F.col("priority") == 2) | F.col("priority").isNull(), F.lit("Mailed check"))
        .when(F.col("priority") == 3, F.lit("Bank transfer"))
        .otherwise(F.lit("Credit card"))
    )
    quarter = (F.year("as_of") - FIRST_SNAPSHOT.year) * 4 + F.quarter("as_of") - 1
    return [
        F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("as_of").cast("string")).alias("customerID"),
        (F.col("c_custkey") * 100 + quarter).cast("long").alias("customer_no"),
        F.col("as_of"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.when(F.col("c_acctbal") < 0, F.lit(1)).otherwise(F.lit(0)).alias("SeniorCitizen"),
        yes(F.col("c_nationkey") % 2 == 1).alias("Partner"),
        yes(F.col("c_nationkey") % 3 == 0).alias("Dependents"),
        F.floor(F.datediff("as_of", "first_order") / 30).cast("int").alias("tenure"),
        yes(has(PART_BITS["STANDARD"])).alias("PhoneService"),
        F.when(~has(PART_BITS["STANDARD"]), F.lit("No phone service"))
        .otherwise(yes(has(PART_BITS["ECONOMY"]))).alias("MultipleLines"),
        internet.alias("InternetService"),
        online(has(PART_BITS["MEDIUM"])).alias("OnlineSecurity"),
        online(has(PART_BITS["SMALL"])).alias("OnlineBackup"),
        online(has(PART_BITS["LARGE"])).alias("DeviceProtection"),
        online(has(PART_BITS["PROMO"])).alias("TechSupport"),
        online(has(RETURNED_BIT)).alias("StreamingTV"),
        online(has(URGENT_BIT)).alias("StreamingMovies"),
        contract.alias("Contract"),
        yes(F.col("c_custkey") % 2 == 1).alias("PaperlessBilling"),
        payment.alias("PaymentMethod"),
        # cents / 12 months / 500, to whole cents, half up, in integers
        (F.floor((cents + 3000) / F.lit(6000)) / F.lit(100.0)).alias("MonthlyCharges"),
        F.when(cents == 0, F.lit(" "))
        .otherwise((cents.cast("decimal(20,0)") * F.lit("0.00002").cast("decimal(6,5)")).cast("decimal(28,5)").cast("string"))
        .alias("TotalCharges"),
        F.when(F.coalesce("later", F.lit(0)) == 1, F.lit("No")).otherwise(F.lit("Yes")).alias("Churn"),
    ]


def panel_from(spark: SparkSession, folder: str) -> DataFrame:
    """Panel over the order tables stored as Parquet in ``folder``."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    shuffled(spark, read("lineitem").count())
    return snapshot_panel(read("customer"), read("orders"), read("lineitem"), read("part"))
