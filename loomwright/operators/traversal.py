"""Serving from the property graph: edges with properties, lookups, rankings, comparisons, dispatch with fallbacks.

Everything works on many start nodes at once: requests are a frame, never a loop over them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def property_edges(*parts: tuple[DataFrame, str, str, str, dict[str, str], str | None]) -> DataFrame:
    """edge_id, src, dst, type, props from (frame, source column, target column, type, {property: column}, qualifier).

    edge_id is src_type_dst, with the qualifier's value at its end where there is one. Edges of one edge_id are one;
    of their properties those of later parts win, inside a part the larger. Null ends give no edge, null properties
    and null qualifiers are left out.
    """
    rows = []
    for n, (df, s, d, kind, props, qualifier) in enumerate(parts):
        key = F.concat_ws("_", F.col(s).cast("string"), F.lit(kind), F.col(d).cast("string"), *([F.col(qualifier).cast("string")] if qualifier else []))
        entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in props.items()]) if props else F.array().cast("array<struct<k:string,v:string>>")
        rows.append(df.where(F.col(s).isNotNull() & F.col(d).isNotNull()).select(key.alias("edge_id"), F.col(s).cast("string").alias("src"), F.col(d).cast("string").alias("dst"), F.lit(kind).alias("type"), F.lit(n).alias("n"), F.filter(entries, lambda e: e["v"].isNotNull()).alias("e")))
    flat = reduce(DataFrame.unionByName, rows).select("edge_id", "src", "dst", "type", "n", F.explode_outer("e").alias("e"))
    keys = ["edge_id", "src", "dst", "type"]
    last = flat.groupBy(*keys, F.col("e.k").alias("k")).agg(F.max(F.struct("n", "e.v")).alias("m"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", F.col("m.v").alias("v")))))).alias("props"))


def prop(name: str, kind: str = "double") -> Column:
    """A property of a node or an edge; null where it is missing or of another type."""
    return F.try_element_at("props", F.lit(name)).try_cast(kind)


def lookup(node: DataFrame, values: DataFrame, props: list[str]) -> DataFrame:
    """value, id: nodes whose id or one of the properties is the value, case and outer space aside; id null if there is none.

    ``values``: value. Each property is an equality join, none a scan of all pairs.
    """
    key = lambda c: F.lower(F.trim(c))
    names = F.array(F.col("id"), *[F.try_element_at("props", F.lit(p)) for p in props])
    keys = node.select("id", F.explode(F.array_distinct(F.transform(names, key))).alias("key")).where("key is not null")
    asked = values.select("value").distinct()
    return asked.join(keys, key(F.col("value")) == F.col("key"), "left").select("value", "id").distinct()


def top_related(edge: DataFrame, kind: str, by: str, k: int = 10, direction: str = "out") -> DataFrame:
    """id, other, rank, <by>: for every node its k neighbours over edges of a type with the largest property; ties by id.

    Edges without the property come last. The rank is limited inside the window, which Spark does before the shuffle.
    """
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    rows = edge.where(F.col("type") == kind).select(F.col(a).alias("id"), F.col(b).alias("other"), prop(by).alias(by))
    w = Window.partitionBy("id").orderBy(F.col(by).desc_nulls_last(), "other")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def head_to_head(edge: DataFrame, pairs: DataFrame, kinds: list[str]) -> DataFrame:
    """a, b, type, reversed, props: for each pair the first edge found: each type from a to b, then from b to a.

    Pairs without any edge have nulls. Of several edges of one type the smallest edge_id counts.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("type"))
    e = edge.where(F.col("type").isin(kinds)).select("edge_id", "src", "dst", "type", "props", order.alias("o"))
    there = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(False).alias("reversed"), "o", "edge_id", "type", "props")
    back = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(True).alias("reversed"), "o", "edge_id", "type", "props")
    both = there.unionByName(back).groupBy("a", "b").agg(F.min_by(F.struct("type", "reversed", "props"), F.struct("reversed", "o", "edge_id")).alias("x"))
    return pairs.select("a", "b").distinct().join(both, ["a", "b"], "left").select("a", "b", "x.type", "x.reversed", "x.props")


def with_tags(edge: DataFrame, kind: str, tags: list[str], every: bool = False) -> DataFrame:
    """id, n_tags: nodes with an edge of the type to any (or every) of the tags, and to how many of them."""
    rows = edge.where((F.col("type") == kind) & F.col("dst").isin(tags)).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n_tags"))
    return rows.where(F.col("n_tags") == len(set(tags))) if every else rows


def role_counters(edge: DataFrame, role_kind: str, role: str, tag_kind: str, tags: list[str]) -> DataFrame:
    """id, n_tags: nodes of a role that have any of the tags; a semi join of two edge types."""
    return with_tags(edge, tag_kind, tags).join(edge.where((F.col("type") == role_kind) & (F.col("dst") == role)).select(F.col("src").alias("id")), "id", "left_semi")


def subgraph(edge: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges whose both ends are among ids (id)."""
    ids = ids.select("id").distinct()
    return edge.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def answer(requests: DataFrame, key: str, kind: str, handlers: dict[str, Callable[[DataFrame], DataFrame]], ladder: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Results of each request by its kind's handler; requests left without result go down the ladder of fallbacks.

    Handlers and fallbacks take requests and give rows with the request's key. ``strategy`` tells which one answered;
    requests nobody answers have a row with the strategy ``none``.
    """
    parts = [h(requests.where(F.col(kind) == k)).withColumn("strategy", F.lit(k)) for k, h in handlers.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for name, fallback in ladder:
        left = requests.join(out.select(key), key, "left_anti")
        out = out.unionByName(fallback(left).withColumn("strategy", F.lit(name)), allowMissingColumns=True)
    rest = requests.join(out.select(key), key, "left_anti").select(key, F.lit("none").alias("strategy"))
    return out.unionByName(rest, allowMissingColumns=True)
