"""Text helpers."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepline.roles import WHITESPACE


def strip(col: Column) -> Column:
    """Drop every kind of leading and trailing whitespace."""
    return F.trim(col, F.lit(WHITESPACE))


def cut(col: Column, length: int) -> Column:
    """First ``length`` characters, for display columns."""
    return F.substring(col, 1, length)


def lookup(col: Column, values: dict, default: Column | None = None) -> Column:
    """Small fixed dictionary as a map literal; ``default`` where the key is missing."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), col)
    return found if default is None else F.coalesce(found, default)


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` places of a template with text columns."""
    parts: list[Column] = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts)
