"""Deeply nested records as related flat tables, by shared inlining.

The schema of a record is a graph of element types. An edge says whether the child occurs at most once
or repeatedly. ``analyse`` decides which types get a table of their own: roots, repeated types, types with
more than one parent type (shared) and recursive types. Every other type is a singleton descendant, and its
columns are inlined into the nearest ancestor that has a table. ``shred`` fills the tables; each row has its
own key (record id and path) and the key and type of its parent row.

Values arrive as VARIANT, so one plan reads lists, single objects in place of lists, maps and nulls alike,
and stays inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE, MANY, KEYED = "one", "many", "keyed"


@dataclass(frozen=True)
class Edge:
    """child below parent at the JSON field ``at``.

    ONE: at most once. MANY: a list, or a single object in its place. KEYED: an object whose keys name the
    children; with ``listed`` each value is itself a list (or a single object in its place). ``keys`` maps
    spellings of a key, lower case, to the one used in paths; other keys stay as they are.
    """

    parent: str
    child: str
    at: str
    times: str = ONE
    listed: bool = False
    keys: dict | None = field(default=None, hash=False)


@dataclass(frozen=True)
class Element:
    name: str
    scalars: dict = field(default_factory=dict, hash=False)  # column -> Spark type


@dataclass(frozen=True)
class Graph:
    root: str
    elements: tuple[Element, ...]
    edges: tuple[Edge, ...]

    def element(self, name: str) -> Element:
        return next(e for e in self.elements if e.name == name)

    def below(self, name: str) -> list[Edge]:
        return [e for e in self.edges if e.parent == name]


@dataclass(frozen=True)
class Table:
    """``columns``: column -> (path of fields below the element, type). ``edges``: edges to rows of other
    tables with the path of inlined fields that leads to them."""

    name: str
    columns: dict
    edges: tuple


def analyse(graph: Graph) -> dict[str, Table]:
    """Which element types get tables, and what is inlined into each."""
    parents: dict[str, set[str]] = {}
    for e in graph.edges:
        parents.setdefault(e.child, set()).add(e.parent)

    def reaches(start: str, goal: str) -> bool:
        seen, todo = set(), [start]
        while todo:
            for e in graph.below(todo.pop()):
                if e.child == goal:
                    return True
                if e.child not in seen:
                    seen.add(e.child)
                    todo.append(e.child)
        return False

    own = {graph.root}
    for e in graph.elements:
        repeated = any(x.child == e.name and x.times != ONE for x in graph.edges)
        if repeated or len(parents.get(e.name, ())) > 1 or reaches(e.name, e.name):
            own.add(e.name)

    def inline(name: str, path: tuple[str, ...], columns: dict, edges: list) -> None:
        for c, kind in graph.element(name).scalars.items():
            columns["_".join((*path, c))] = ((*path, c), kind)
        for e in graph.below(name):
            if e.child in own:
                edges.append((path, e))
            else:
                inline(e.child, (*path, e.at), columns, edges)

    tables = {}
    for e in graph.elements:
        if e.name in own:
            columns: dict = {}
            edges: list = []
            inline(e.name, (), columns, edges)
            tables[e.name] = Table(e.name, columns, tuple(edges))
    return tables


def _get(value: Column, path: tuple[str, ...], kind: str) -> Column:
    steps = "".join(f"['{p}']" for p in path)
    return F.try_variant_get(value, "$" + steps, kind)


def _present(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def _items(value: Column) -> Column:
    """The elements of a list; a single object counts as a list of one."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(_present(value), F.array(value)))


def _children(rows: DataFrame, path: tuple[str, ...], e: Edge) -> DataFrame:
    """Rows (record, parent_path, path, node) of one edge; ``rows`` has record, path, node.

    Below the root, ``node`` is missing and the value is the column named like the edge's field.
    """
    value = _get(F.col("node"), (*path, e.at), "variant") if "node" in rows.columns else F.col(e.at)
    base = rows.select("record", F.col("path").alias("parent_path"), value.alias("v"))
    start = F.concat_ws("/", F.nullif(F.col("parent_path"), F.lit("")), F.lit("/".join((*path, e.at))))
    if e.times == KEYED:
        base = base.select("record", "parent_path", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("k", "v"))
        key = F.col("k")
        if e.keys:
            names = F.create_map(*[F.lit(x) for kv in e.keys.items() for x in kv])
            key = F.coalesce(F.try_element_at(names, F.lower(F.trim("k"))), key)
        start = F.concat_ws("/", start, key)
    base = base.select("record", "parent_path", start.alias("p"), "v")
    if e.times == MANY or e.listed:
        base = base.select("record", "parent_path", "p", F.posexplode(_items(F.col("v"))).alias("n", "v"))
        base = base.withColumn("p", F.concat_ws("/", "p", F.col("n").cast("string")))
    return base.where(_present(F.col("v"))).select("record", "parent_path", F.col("p").alias("path"), F.col("v").alias("node"))


def shred(records: DataFrame, graph: Graph, depth: int = 8) -> dict[str, DataFrame]:
    """A table for every element type below the root that analyse() gives one.

    ``records``: the key ``record`` and, for each field of the root that an edge names, a VARIANT column of
    that name; further columns are ignored. Each table has ``record, path, parent_path, parent_kind`` and the
    inlined columns. A null or absent field gives no rows, nor does a null element, though it counts in the
    positions of its list. Fields of another type than declared become null. Repeated input rows give
    repeated output rows. Recursive types are followed ``depth`` levels deep, all others to the end.
    """
    tables = analyse(graph)
    parts: dict[str, list[DataFrame]] = {}

    def walk(name: str, rows: DataFrame, seen: tuple[str, ...]) -> None:
        for path, e in tables[name].edges:
            if seen.count(e.child) >= depth:
                continue
            kids = _children(rows, path, e)
            parts.setdefault(e.child, []).append(kids.withColumn("parent_kind", F.lit(name)))
            walk(e.child, kids.select("record", "path", "node"), (*seen, e.child))

    walk(graph.root, records.withColumn("path", F.lit("")), (graph.root,))
    out = {}
    for name, frames in parts.items():
        rows = reduce(DataFrame.unionByName, frames)
        out[name] = rows.select("record", "path", "parent_path", "parent_kind", *[_get(F.col("node"), p, kind).alias(c) for c, (p, kind) in tables[name].columns.items()])
    return out
