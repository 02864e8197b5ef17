"""Engineered columns. Everything is a plain column expression."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepline.roles import EQUALS_FLAGS, TELCO, TENURE_EDGES, Roles


def recency_score(tenure: Column) -> Column:
    """Short tenure means high recency."""
    return F.lit(1.0) / (tenure + F.lit(1))


def active_services(columns: tuple[str, ...] = TELCO.services) -> Column:
    """How many service columns say 'Yes'."""
    return reduce(add, [equals_flag(F.col(c), "Yes") for c in columns])


def lifetime_value(monthly: Column, tenure: Column) -> Column:
    return monthly * tenure


def charge_per_service(monthly: Column, services: Column) -> Column:
    return monthly / (services + F.lit(1))


def equals_flag(col: Column, value: str) -> Column:
    """1 where the column equals the value, 0 otherwise and for null."""
    return col.eqNullSafe(F.lit(value)).cast("int")


def tenure_bucket(tenure: Column, edges: tuple[int, ...] = TENURE_EDGES) -> Column:
    """0 up to the first edge, 1 up to the second, 2 beyond; null stays null."""
    bucket = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        bucket = F.when(tenure <= edge, F.lit(i)).otherwise(bucket)
    return F.when(tenure.isNotNull(), bucket)


def engineer(df: DataFrame, roles: Roles = TELCO) -> DataFrame:
    """Adds all ten engineered columns."""
    tenure, monthly = F.col("tenure"), F.col("MonthlyCharges")
    base = df.withColumn("active_services", active_services(roles.services))
    added = {
        "recency_score": recency_score(tenure),
        "active_services": F.col("active_services"),
        "lifetime_value": lifetime_value(monthly, tenure),
        "charge_per_service": charge_per_service(monthly, F.col("active_services")),
        **{flag: equals_flag(F.col(c), v) for flag, (c, v) in EQUALS_FLAGS.items()},
        "is_senior": F.col("SeniorCitizen"),
        "tenure_bucket": tenure_bucket(tenure),
    }
    return base.withColumns({c: added[c] for c in roles.engineered})
