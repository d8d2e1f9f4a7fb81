"""Joins of the knowledge base: precedence merges, alias lookups, blocked pairs, baskets, division."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions.arrays import first_present


def key_union(key: str, *frames: DataFrame) -> DataFrame:
    """All different keys of several frames; null keys are left out."""
    return reduce(DataFrame.union, [f.select(key) for f in frames]).where(F.col(key).isNotNull()).distinct()


def merge_by_precedence(key: str, sources: dict[str, DataFrame], fields: dict[str, list[str]], kinds: dict[str, str] | None = None) -> DataFrame:
    """One row a key of any source; each field from the first source (in its order) where it isn't missing.

    Keys have to be unique in each source. ``sources_seen`` lists the sources that have the key.
    """
    out = key_union(key, *sources.values())
    for name, f in sources.items():
        cols = [c for c, order in fields.items() if name in order and c in f.columns]
        out = out.join(f.select(key, *[F.col(c).alias(f"{name}__{c}") for c in cols], F.lit(True).alias(f"{name}__here")), key, "left")
    picked = [first_present(*[f"{s}__{c}" for s in order if f"{s}__{c}" in out.columns], kind=(kinds or {}).get(c, "string")).alias(c) for c, order in fields.items()]
    seen = F.array_compact(F.array(*[F.when(F.col(f"{s}__here"), F.lit(s)) for s in sources]))
    return out.select(key, *picked, F.array_join(seen, "+").alias("sources_seen"))


def resolve_alias(df: DataFrame, column: str, alias: DataFrame, default: Column | None = None) -> DataFrame:
    """df with ``resolved``: the id of the alias, else the default (the value itself).

    ``alias``: alias, id; where an alias has several ids the smallest is taken.
    """
    a = alias.groupBy("alias").agg(F.min("id").alias("_id"))
    return df.join(a, F.col(column) == F.col("alias"), "left").withColumn("resolved", F.coalesce("_id", F.col(column) if default is None else default)).drop("alias", "_id")


def fuzzy_lookup(wanted: DataFrame, names: DataFrame, max_prefix: int = 4) -> DataFrame:
    """wanted (query) with the best of names (id, name): exact, then case aside, then the name contains the query.

    Within one way the smallest id wins; queries found in no way come out with null. Containment is tried only for
    queries left over, over the pairs that share a word, so no pair of unlike texts is formed.
    """
    q = wanted.select("query").distinct()
    exact = q.join(names, F.col("query") == F.col("name")).select("query", "id", F.lit(1).alias("way"))
    folded = q.join(names, F.lower("query") == F.lower("name")).select("query", "id", F.lit(2).alias("way"))
    word = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), " ")))
    rest = q.join(folded.select("query").distinct(), "query", "left_anti")
    part = rest.withColumn("w", word("query")).join(names.withColumn("w", word("name")), "w").where(F.contains(F.lower("name"), F.lower("query"))).select("query", "id", F.lit(3).alias("way"))
    best = exact.union(folded).union(part).groupBy("query").agg(F.min(F.struct("way", "id")).alias("b"))
    return wanted.join(best, "query", "left").select("query", F.col("b.id").alias("id"), F.col("b.way").alias("way"))


def either_key(df: DataFrame, left: str, other: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Rows of df joined where ``left`` equals one of several keys of other: a union of equi-joins, each pair once."""
    parts = [df.join(other.select(*{*keys, *keep}), F.col(left) == F.col(k)).select(*df.columns, *keep) for k in keys]
    return reduce(DataFrame.union, parts).distinct()


def basket_pairs(df: DataFrame, basket: str, item: str, win: str) -> DataFrame:
    """a, b (a < b), games, wins: how often two items share a basket, each basket counted once.

    Items of a basket are made distinct first. Pairs grow with the square of a basket's items, which a basket's
    nature bounds (a line-up, an order); it isn't meant for baskets of unbounded size.
    """
    d = df.groupBy(basket, item).agg(F.bool_or(win).alias("w"))
    a, b = d.select(basket, F.col(item).alias("a"), F.col("w").alias("wa")), d.select(basket, F.col(item).alias("b"), F.col("w").alias("wb"))
    return a.join(b, basket).where("a < b").groupBy("a", "b").agg(F.count("*").alias("games"), F.count_if(F.col("wa") & F.col("wb")).alias("wins"))


def blocked_pairs(df: DataFrame, key: str, block: str, keep: list[str]) -> DataFrame:
    """Ordered pairs of rows that share a block, a_* and b_* columns."""
    a = df.select(F.col(block), F.col(key).alias(f"a_{key}"), *[F.col(c).alias(f"a_{c}") for c in keep])
    b = df.select(F.col(block), F.col(key).alias(f"b_{key}"), *[F.col(c).alias(f"b_{c}") for c in keep])
    return a.join(b, block).where(F.col(f"a_{key}") != F.col(f"b_{key}"))


def division(df: DataFrame, key: str, tag: str, wanted: list[str]) -> DataFrame:
    """Keys that have all wanted tags."""
    return df.where(F.col(tag).isin(*wanted)).groupBy(key).agg(F.count_distinct(tag).alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, into: str = "rank") -> DataFrame:
    """The first n rows of each group in a total order, numbered from 1."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(into) <= n)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: that with the largest values of ``order``. A maximum over structs, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return one.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def overlay(base: DataFrame, over: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the values of ``over``."""
    b, o = base.select(*key, *[F.col(c).alias(f"b_{c}") for c in values]), over.select(*key, *[F.col(c).alias(f"o_{c}") for c in values], F.lit(True).alias("_o"))
    return b.join(o, key, "full").select(*key, *[F.when(F.col("_o"), F.col(f"o_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in values])


def or_all(df: DataFrame, condition: Column) -> DataFrame:
    """The rows meeting the condition, or all rows where none does. Looks for one such row when it is called."""
    kept = df.where(condition)
    return df if kept.isEmpty() else kept
