"""Flattening, keyed maps, profiles and selections of entity records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def flatten_sources(parts: dict[str, tuple[DataFrame, dict[str, str | Column]]]) -> DataFrame:
    """One frame of all sources' rows in common columns; ``parts``: source -> (frame, {column: its column there}).

    Columns a source lacks are null, further columns of the frames are dropped.
    """
    names = list(dict.fromkeys(c for _, m in parts.values() for c in m))
    rows = [df.select(F.lit(k).alias("source"), *[(m[c] if isinstance(m[c], Column) else F.col(m[c])).alias(c) if c in m else F.lit(None).alias(c) for c in names]) for k, (df, m) in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def keyed(items: Column, keys: list[str]) -> Column:
    """A list as a map by ordinal: the first item at the first key and so on; items beyond the keys and nulls are left out."""
    pairs = F.transform(F.arrays_zip(F.array(*[F.lit(k) for k in keys]).alias("k"), F.slice(items, 1, len(keys)).alias("v")), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def filled(props: dict[str, Column]) -> Column:
    """Map of the properties that say something; null and blank ones are left out."""
    made = F.create_map(*[x for k, c in props.items() for x in (F.lit(k), c.cast("string"))])
    return F.map_filter(made, lambda _, v: v.isNotNull() & (F.trim(v) != ""))


def at_rank(values: Column, rank: Column) -> Column:
    """The value of a rank (from 1) as a list of one; the whole list where there is no such rank."""
    inside = (rank >= 1) & (rank <= F.size(values))
    return F.when(inside, F.slice(values, F.greatest(rank, F.lit(1)), 1)).otherwise(values)


def base_and_growth(stats: Column) -> Column:
    """struct<base, growth>: maps of the flat and the per-level numbers that aren't null."""
    part = lambda f: F.map_filter(F.transform_values(stats, lambda _, v: v[f]), lambda _, v: v.isNotNull())
    return F.struct(part("flat").alias("base"), part("perLevel").alias("growth"))


def contained(asked: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """asked, name: the name equal to what is asked; else the longest one that holds it or is held by it.

    Candidates share a run of ``least`` characters, so no pair is formed without; shorter texts only match as
    they are. Case and outer space don't count; ties go to the smallest name.
    """
    low = lambda c: F.lower(F.trim(c))
    grams = lambda c: F.array_distinct(F.when(F.length(c) >= least, F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(c, i, F.lit(least)))).otherwise(F.array(c)))
    a = asked.select("asked").distinct().withColumn("x", low(F.col("asked"))).where("x != ''")
    n = names.select("name").distinct().withColumn("y", low(F.col("name"))).where("y != ''")
    # one run of each name is enough for names held; one run of what is asked for names that hold it
    first = lambda c: F.substring(c, 1, least)
    held = n.withColumn("g", first(F.col("y"))).join(a.withColumn("g", F.explode(grams(F.col("x")))), "g")
    holds = n.withColumn("g", F.explode(grams(F.col("y")))).join(a.withColumn("g", first(F.col("x"))), "g")
    both = held.select("asked", "name", "x", "y").unionByName(holds.select("asked", "name", "x", "y")).where(F.contains("x", "y") | F.contains("y", "x"))
    both = both.where((F.col("x") == F.col("y")) | ((F.length("x") >= least) & (F.length("y") >= least)))
    best = F.min_by("name", F.struct(F.col("x") != F.col("y"), -F.length("y"), "name"))
    return asked.select("asked").distinct().join(both.groupBy("asked").agg(best.alias("name")), "asked", "left")


def resolve_ids(df: DataFrame, key: str, ids: str, names: DataFrame) -> DataFrame:
    """key, names: a list of ids with their names in place, in order; ids without name stay. ``names``: id, name."""
    rows = df.select(key, F.posexplode(ids).alias("p", "id")).join(names.select(F.col("id").cast("string").alias("id"), "name"), "id", "left")
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("name", "id").alias("name")))).alias("a"))  # as long as the list was
    return one.select(key, F.transform("a", lambda x: x["name"]).alias("names"))


def most_common(df: DataFrame, by: str, value: str, n: int, mixed: str | None = None) -> DataFrame:
    """by, value, n, rank: the n most frequent values of each group; ties by value.

    With ``mixed`` only the first, or ``mixed`` in its place where two are equally frequent.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), value)
    c = c.withColumns({"rank": F.row_number().over(w), "next": F.lead("n").over(w)}).where(F.col("rank") <= (1 if mixed else n))
    if mixed:
        c = c.withColumn(value, F.when(F.col("next") == F.col("n"), mixed).otherwise(F.col(value)))
    return c.drop("next")


def with_samples(df: DataFrame, by: str, item: str, n: int = 10) -> DataFrame:
    """by, n, samples: the number of rows of each group and its n smallest different items."""
    first = df.select(by, item).where(F.col(item).isNotNull()).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(item))).where(F.col("_r") <= n)
    return df.groupBy(by).agg(F.count("*").alias("n")).join(first.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("samples")), by, "left")


def large_share(df: DataFrame, by: str, value: str, least: int = 2, share: float = 0.6) -> DataFrame:
    """by, value, n: values that at least ``least`` rows of a group have, and that share of its rows."""
    c = df.groupBy(by, value).agg(F.count("*").alias("n"))
    total = c.groupBy(by).agg(F.sum("n").alias("_all"))
    return c.join(total, by).where(F.col(value).isNotNull() & (F.col("n") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("_all")))).drop("_all")


def preferred_first(df: DataFrame, by: str, preferred: Column, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group: those preferred in order, then the others in order; ``rank`` from 1."""
    w = Window.partitionBy(by).orderBy(F.when(preferred, 0).otherwise(1), *order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def numeric_order(c: str) -> list[Column]:
    """Order of ids in which numbers stand by size before texts."""
    n = F.col(c).try_cast("bigint")
    return [n.isNull().asc(), n.asc(), F.col(c).asc()]
