"""Encoding of yes/no and multi-level text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.functions.text import lookup
from keepline.roles import BINARY_VALUES


def map_binary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Yes/No style columns to 1/0; unknown spellings and nulls become 0."""
    return df.withColumns({c: lookup(F.col(c), BINARY_VALUES, F.lit(0)) for c in cols})


def fit_levels(df: DataFrame, cols: list[str], max_levels: int = 1000) -> dict[str, tuple[str, ...]]:
    """Sorted non-null levels per column, from one distributed pass.

    The levels become columns, so they have to be known to the plan; more than ``max_levels``
    is an error, never a cut.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("level")) for c in cols]
    )
    found = (
        df.select(*cols).distinct()  # few combinations, so the rows are not multiplied by the columns
        .select(F.inline(pairs))
        .where(F.col("level").isNotNull())
        .distinct()
        .limit(max_levels + 1)
        .collect()
    )
    if len(found) > max_levels:
        raise ValueError(f"more than {max_levels} levels in {cols}; not categorical columns")
    return {c: tuple(sorted(r["level"] for r in found if r["col"] == c)) for c in cols}


def one_hot(df: DataFrame, levels: dict[str, tuple[str, ...]]) -> DataFrame:
    """Replaces each column by one 0/1 column per fitted level, named ``<column>_<level>``.

    All levels are kept. A level unseen at fit time, or a null, gives zeros throughout.
    """
    made = {
        f"{c}_{level}": F.col(c).eqNullSafe(F.lit(level)).cast("int")
        for c, values in levels.items()
        for level in values
    }
    return df.withColumns(made).drop(*levels)


def bools_to_int(df: DataFrame) -> DataFrame:
    """Boolean columns to 0/1."""
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("int") for c in flags}) if flags else df
