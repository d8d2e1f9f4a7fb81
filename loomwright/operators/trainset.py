"""Training sets of the knowledge base: splits by hash, first of repeats, leaks, hard negatives, templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket(key: Column, buckets: int = 10) -> Column:
    """A bucket of the key by md5, the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def split_of(key: Column) -> Column:
    """train, val, test at 8:1:1."""
    return F.when(bucket(key) < 8, "train").when(bucket(key) == 8, "val").otherwise("test")


def first_of(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key, by a minimum that tasks combine before the shuffle."""
    cols = df.columns
    rest = F.struct(*[F.col(c) for c in cols])
    return df.groupBy(key.alias("_k")).agg(F.min_by(rest, order).alias("r")).select("r.*")


def leakage(df: DataFrame, split: str, text: Column, fold: bool = True) -> DataFrame:
    """a, b, n: different texts (trimmed, case aside if ``fold``) that two splits share, for each two splits."""
    t = F.trim(text)
    d = df.select(F.col(split).alias("s"), (F.lower(t) if fold else t).alias("t")).where("t != ''").distinct()
    x, y = d.select(F.col("s").alias("a"), "t"), d.select(F.col("s").alias("b"), "t")
    return x.join(y, "t").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def clean_of(df: DataFrame, held: DataFrame, *texts: Column) -> DataFrame:
    """Rows none of whose texts occurs in the same column of held rows."""
    out = df
    for n, t in enumerate(texts):
        known = held.select(F.lower(F.trim(t)).alias(f"_h{n}")).where(f"_h{n} is not null").distinct()
        out = out.withColumn("_t", F.lower(F.trim(t))).join(known, F.col("_t") == F.col(f"_h{n}"), "left_anti").drop("_t")
    return out


def hard_negatives(anchors: DataFrame, pool: DataFrame, tiers: list[list[str]], seed: str = "42") -> DataFrame:
    """anchor_id, negative_id, tier: a pool row that shares the columns of the first tier it can, of another ``group``.

    Within a tier the smallest md5 of both ids and the seed wins. Each tier is an equi-join of the anchors that are
    left with, for each key, the few pool rows of smallest hash in two groups: the anchor's own group is
    never both, so no anchor loses its tier, and no key multiplies all its rows.
    """
    left, done = anchors, []
    for n, cols in enumerate(tiers, 1):
        h = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(seed)))
        best = pool.groupBy(*cols, "group").agg(F.min(F.struct(h.alias("h"), "id")).alias("b"))
        two = best.withColumn("k", F.row_number().over(Window.partitionBy(*cols).orderBy("b.h", "b.id"))).where("k <= 2")
        got = left.join(two.select(*cols, F.col("group").alias("_g"), "b"), cols).where(F.col("group") != F.col("_g"))
        one = got.groupBy(F.col("id").alias("anchor_id")).agg(F.min("b").alias("b")).select("anchor_id", F.col("b.id").alias("negative_id"), F.lit(n).alias("tier"))
        done.append(one)
        left = left.join(one.select(F.col("anchor_id").alias("id")), "id", "left_anti")
    return reduce(DataFrame.unionByName, done)


def templated(entities: DataFrame, key: str, templates: list[str], name: str, each: int, seed: str = "42") -> DataFrame:
    """key, template, query: for each entity ``each`` of the templates, those of smallest md5."""
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("template"), F.lit(x).alias("pattern")) for i, x in enumerate(templates)]))
    rows = entities.select(key, name, t.alias("t")).select(key, name, "t.*")
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("template").cast("string"), F.lit(seed)))
    w = Window.partitionBy(key).orderBy(h, "template")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).select(key, "template", F.replace(F.col("pattern"), F.lit("{}"), F.col(name)).alias("query"))
