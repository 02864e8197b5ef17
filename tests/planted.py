"""A telco table whose churn depends on its columns.

Drawn from md5 of the row number, so it is the same whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepline.sources.customers import RAW_COLUMNS


def draw(name: str, seed: int = 7) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col("id").cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def pick(name: str, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(draw(name) * len(values)) + 1).cast("int"))


def planted(spark: SparkSession, n: int = 4000, seed_parts: int = 4) -> DataFrame:
    yes_no, online = ["Yes", "No"], ["Yes", "No", "No internet service"]
    df = spark.range(0, n, 1, seed_parts).select(
        "id",
        F.format_string("C%06d", "id").alias("customerID"),
        pick("gender", ["Female", "Male"]).alias("gender"),
        (draw("senior") < 0.16).cast("int").alias("SeniorCitizen"),
        pick("partner", yes_no).alias("Partner"),
        pick("dependents", yes_no).alias("Dependents"),
        F.floor(draw("tenure") * 72).cast("int").alias("tenure"),
        pick("phone", yes_no).alias("PhoneService"),
        pick("lines", ["Yes", "No", "No phone service"]).alias("MultipleLines"),
        pick("net", ["DSL", "Fiber optic", "No"]).alias("InternetService"),
        *[
            pick(c, online).alias(c)
            for c in ("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies")
        ],
        pick("contract", ["Month-to-month", "One year", "Two year"]).alias("Contract"),
        pick("paper", yes_no).alias("PaperlessBilling"),
        pick("pay", ["Electronic check", "Mailed check", "Bank transfer", "Credit card"]).alias("PaymentMethod"),
        F.round(20 + draw("monthly") * 100, 2).alias("MonthlyCharges"),
    )
    total = F.format_string("%.2f", F.col("MonthlyCharges") * F.col("tenure"))
    margin = (
        F.lit(-1.5)
        + 1.8 * (F.col("Contract") == "Month-to-month").cast("int")
        + 1.0 * (F.col("InternetService") == "Fiber optic").cast("int")
        + 0.8 * (F.col("OnlineSecurity") == "No").cast("int")
        - 0.04 * F.col("tenure")
    )
    df = df.withColumns(
        {
            "TotalCharges": F.when(F.col("tenure") == 0, F.lit(" ")).otherwise(total),
            "Churn": F.when(draw("churn") < 1 / (1 + F.exp(-margin)), F.lit("Yes")).otherwise(F.lit("No")),
        }
    )
    return df.select(*RAW_COLUMNS)
