"""Entities of the knowledge base: filters by many criteria, fields filled from a parent, checks of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.arrays import any_contains, first_present, has_all, has_any


def filter_entities(df: DataFrame, any_of: dict[str, list[str]] | None = None, all_of: dict[str, list[str]] | None = None, part_of: dict[str, str] | None = None, equal: dict[str, str] | None = None) -> DataFrame:
    """Rows that meet every criterion given.

    ``any_of``: the list column holds one of the values; ``all_of``: it holds all; ``part_of``: an element contains
    the text, case aside; ``equal``: the column is the value, case aside. Null columns meet none.
    """
    for c, values in (any_of or {}).items():
        df = df.where(has_any(c, values))
    for c, values in (all_of or {}).items():
        df = df.where(has_all(c, values))
    for c, text in (part_of or {}).items():
        df = df.where(any_contains(c, text))
    for c, value in (equal or {}).items():
        df = df.where(F.lower(c) == value.lower())
    return df


def fill_missing(df: DataFrame, parent: DataFrame, key: str, fields: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Fields of df, where missing those of the parent row of the same key; parents' keys have to be unique."""
    p = parent.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = df.join(p, key, "left")
    return out.withColumns({f: first_present(f, f"_{f}", kind=(kinds or {}).get(f, "string")) for f in fields}).drop(*[f"_{f}" for f in fields])


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once, with their number: empty where a uniqueness constraint holds."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def lineage(sources: dict[str, Column]) -> Column:
    """Names of the sources whose condition holds, in order, joined by +."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in sources.items()])), "+")
