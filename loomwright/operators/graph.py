"""Typed property graph in two frames: node(id, label, props), edge(src, dst, type, props)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.session import through_table


def nodes(*parts: tuple[DataFrame, str, str, dict[str, str]]) -> DataFrame:
    """Node rows from (frame, id column, label, {property: column}); of equal ids the properties of later parts
    win where they aren't null."""
    rows = []
    for n, (df, key, label, props) in enumerate(parts):
        m = F.map_filter(F.create_map(*[x for p, c in props.items() for x in (F.lit(p), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if props else F.create_map().cast("map<string,string>")
        rows.append(df.where(F.col(key).isNotNull()).select(F.concat_ws(":", F.lit(label), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), m.alias("props"), F.lit(n).alias("_n")))
    entries = reduce(DataFrame.unionByName, rows).select("id", "label", "_n", F.explode_outer("props").alias("k", "v"))
    last = entries.groupBy("id", "label", "k").agg(F.max_by("v", F.struct("_n", "v")).alias("v"))
    return last.groupBy("id", "label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))).alias("props"))


def edges(*parts: tuple[DataFrame, str, str, str, str, str]) -> DataFrame:
    """src, dst, type from (frame, source column, its label, target column, its label, type); each edge once."""
    rows = [
        df.where(F.col(s).isNotNull() & F.col(d).isNotNull()).select(F.concat_ws(":", F.lit(sl), F.col(s).cast("string")).alias("src"), F.concat_ws(":", F.lit(dl), F.col(d).cast("string")).alias("dst"), F.lit(kind).alias("type"))
        for df, s, sl, d, dl, kind in parts
    ]
    return reduce(DataFrame.unionByName, rows).distinct()


def with_ends(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    ids = node.select("id")
    return edge.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def both_ways(edge: DataFrame) -> DataFrame:
    """a, b of every edge and its reverse, each once."""
    return edge.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edge.select("dst", "src")).distinct()


def neighbours(edge: DataFrame, at: str, direction: str = "both", most: int | None = None) -> DataFrame:
    """Ids next to a node: along edges (out), against them (in), or both; ``most``: only the first by id and type."""
    out = edge.where(F.col("src") == at).select(F.col("dst").alias("id"), "type")
    into = edge.where(F.col("dst") == at).select(F.col("src").alias("id"), "type")
    rows = {"out": out, "in": into}.get(direction, out.union(into)).distinct()
    return rows.orderBy("id", "type").limit(most) if most else rows


def within_hops(edge: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """id, hops: nodes reached from starts (id) over edges in any direction, with the fewest hops.

    Breadth first: each round joins the newest nodes to the edges and drops those seen before. Rounds are written
    to the shared folder, so the plan doesn't grow and a lost executor costs one round.
    """
    way = through_table(both_ways(edge), "way")
    seen = front = starts.select("id").distinct().withColumn("hops", F.lit(0))
    for n in range(1, depth + 1):
        step = front.join(way, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        front = through_table(step.join(seen, "id", "left_anti").withColumn("hops", F.lit(n)), "hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edge: DataFrame, start: str, depth: int) -> DataFrame:
    """id, hops, path: one shortest path from start to every node within depth; of equal ones the smallest."""
    way = through_table(both_ways(edge), "way")
    one = edge.sparkSession.createDataFrame([(start,)], "id string")
    seen = front = one.select("id", F.lit(0).alias("hops"), F.array("id").alias("path"))
    for n in range(1, depth + 1):
        step = front.join(way, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min("path").alias("path"))
        step = step.select("id", F.lit(n).alias("hops"), F.concat("path", F.array("id")).alias("path"))
        front = through_table(step.join(seen.select("id"), "id", "left_anti"), "paths")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def optional_sets(base: DataFrame, key: str, edge: DataFrame, kinds: list[str], most: int | None = None) -> DataFrame:
    """base with a list column for each edge type: sorted different targets, empty where there are none.

    Each type is aggregated before it is joined, so types don't multiply. ``most`` keeps the first targets of each
    node before they are brought together; without it a list is as long as its node has neighbours.
    """
    out = base
    for k in kinds:
        rows = edge.where(F.col("type") == k).select(F.col("src").alias(key), "dst").distinct()
        if most:
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("dst"))).where(F.col("_n") <= most)
        t = rows.groupBy(key).agg(F.array_sort(F.collect_list("dst")).alias(k))
        out = out.join(t, key, "left").withColumn(k, F.coalesce(k, F.array().cast("array<string>")))
    return out


def degrees(edge: DataFrame) -> DataFrame:
    """id, degree over different neighbours."""
    return both_ways(edge).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def counts(node: DataFrame, edge: DataFrame) -> DataFrame:
    """kind (node or edge), name, n."""
    a = node.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return a.union(edge.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge"), "name", "n"))
