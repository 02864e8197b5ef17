"""Customer tables from and to files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.session import as_table

# The columns of a raw customer table, in file order.
RAW_COLUMNS = {
    "customerID": "string", "gender": "string", "SeniorCitizen": "int", "Partner": "string",
    "Dependents": "string", "tenure": "int", "PhoneService": "string", "MultipleLines": "string",
    "InternetService": "string", "OnlineSecurity": "string", "OnlineBackup": "string",
    "DeviceProtection": "string", "TechSupport": "string", "StreamingTV": "string",
    "StreamingMovies": "string", "Contract": "string", "PaperlessBilling": "string",
    "PaymentMethod": "string", "MonthlyCharges": "double", "TotalCharges": "string",
    "Churn": "string",
}
RAW_SCHEMA = ", ".join(f"{c} {t}" for c, t in RAW_COLUMNS.items())


class MissingSource(FileNotFoundError):
    """The input is not there. Raised while planning, before any job starts."""


def _open(reader, path: str) -> DataFrame:
    try:
        return reader.load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise MissingSource(f"no customer data at {path}") from None
        raise


def read_customers(
    spark: SparkSession, path: str, format: str = "csv", schema: str | T.StructType = RAW_SCHEMA
) -> DataFrame:
    """A raw customer table with a declared schema; nothing is inferred from the data."""
    reader = spark.read.schema(schema).format(format)
    return _open(reader.option("header", True) if format == "csv" else reader, path)


DAMAGED = "_damaged"


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The readable rows of a customer CSV file, and the lines (line) that don't fit the schema.

    A line is damaged if a number can't be read or if it has too few or too many cells; `read_customers`
    makes nulls of such cells instead. The file is read once, whole, and stored: of columns that a plan
    leaves out, Spark would not see the damage.
    """
    reader = spark.read.schema(f"{RAW_SCHEMA}, {DAMAGED} string").format("csv").option("header", True)
    rows = as_table(_open(reader.option("columnNameOfCorruptRecord", DAMAGED), path), "checked")
    return rows.where(F.col(DAMAGED).isNull()).drop(DAMAGED), rows.where(F.col(DAMAGED).isNotNull()).select(F.col(DAMAGED).alias("line"))


def verify_source(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Shape of a customer file, or a clear error when it is not there."""
    table = read_customers(spark, path, format)
    return table.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(table.columns)))


CSV_OPTIONS = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(df: DataFrame, path: str) -> None:
    """Header CSV, blanks kept as they are, one file per partition."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    """Feature table with key and label, one directory per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A stored feature table; naming a split reads only that directory."""
    table = _open(spark.read.format("parquet"), path)
    return table if split is None else table.where(table["split"] == split)
