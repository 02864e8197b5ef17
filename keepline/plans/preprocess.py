"""Raw customer table to model-ready features, as one lazy plan after small fit steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepline.operators.clean import (
    binary_target,
    coerce_numeric,
    fit_medians,
    impute,
    store_distinct,
    trim_strings,
)
from keepline.operators.encode import bools_to_int, fit_levels, map_binary, one_hot
from keepline.operators.features import engineer
from keepline.operators.scale import apply_scaler, fit_scaler
from keepline.operators.split import stratified_split
from keepline.roles import TELCO, Roles
from keepline.session import as_table

SCALED = "_scaled"


@dataclass
class Prepared:
    """Features with key, label and split, and what was fitted on the way."""

    features: DataFrame
    names: list[str]
    medians: DataFrame
    levels: dict[str, tuple[str, ...]]
    scaler: DataFrame

    @property
    def scaled_names(self) -> list[str]:
        return [n + SCALED for n in self.names]


def clean(df: DataFrame, roles: Roles = TELCO) -> DataFrame:
    """Numbers parsed, label added, strings stripped."""
    parsed = coerce_numeric(df, list(roles.text_numeric))
    labelled = binary_target(parsed, roles.target, roles.positive, roles.label)
    return trim_strings(labelled)


def raw_features(
    cleaned: DataFrame, medians: DataFrame, levels: dict[str, tuple[str, ...]], roles: Roles = TELCO
) -> tuple[DataFrame, list[str]]:
    """Filled, engineered and encoded columns, and the list of feature names."""
    filled = impute(cleaned, medians)
    encoded = bools_to_int(one_hot(map_binary(engineer(filled, roles), list(roles.binary)), levels))
    hot = [f"{c}_{v}" for c in roles.categorical for v in levels[c]]
    return encoded, [*roles.numeric, *roles.binary, *roles.engineered, *hot]


def preprocess(
    df: DataFrame,
    roles: Roles = TELCO,
    fit_on: str = "train",
    test_size: float = 0.2,
    seed: int = 42,
    keep: tuple[str, ...] = (),
    digits: int | None = None,
) -> Prepared:
    """Clean, split, fill, engineer, encode and scale; raw and scaled columns side by side.

    The raw columns are stored; the scaled ones are worked out from them when they are read.

    ``fit_on='train'`` learns medians, levels and scaling from the training side only;
    ``'all'`` fills with the median of the whole table, as it stood before duplicates went.
    """
    # Written once: every fit below reads its result.
    cleaned = store_distinct(clean(df, roles), "cleaned")
    parted = stratified_split(cleaned, roles.key, roles.label, test_size, seed, digits)
    train = F.col("split") == "train"
    numbers = list(roles.text_numeric)
    seen = coerce_numeric(df, numbers) if fit_on == "all" else parted.where(train)
    medians = fit_medians(seen, numbers)
    levels = fit_levels(parted if fit_on == "all" else parted.where(train), list(roles.categorical))
    encoded, names = raw_features(parted, medians, levels, roles)
    columns = [roles.key, *keep, roles.label, "split", *names]
    raw = as_table(encoded.select(*[F.col(f"`{c}`") for c in columns]), "features")
    scaler = fit_scaler(raw.where(train), names)
    return Prepared(apply_scaler(raw, scaler, SCALED), names, medians, levels, scaler)
