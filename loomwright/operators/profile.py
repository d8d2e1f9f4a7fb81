"""Profiling: descriptive statistics, frequencies, completeness, consistency, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions.arrays import nullif_empty
from loomwright.functions.numeric import digits, safe_ratio


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation, min, quartiles (linear between ranks), max of each group.

    Nulls and NaN don't count; a group without values has n 0 and 0 everywhere; one value has deviation 0.
    """
    v = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"))
    out = out.withColumns({f"q{p}": F.get("q", F.lit(i)) for i, p in enumerate((25, 50, 75))}).drop("q")
    return out.select(*by, "n", *[digits(F.coalesce(F.when(F.isnan(c), 0.0).otherwise(F.col(c)), F.lit(0.0))).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def frequency(df: DataFrame, value: str, top: int | None = None) -> DataFrame:
    """value, n, pct of all that aren't null; most frequent first, ties by value."""
    rows = df.where(F.col(value).isNotNull())
    total = rows.count()
    out = rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).withColumn("pct", digits(F.col("n") * 100.0 / F.lit(total)))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def completeness(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """column, n_rows, n_missing, pct_present; blank text, empty lists and maps count as missing."""
    missing = [F.count_if(nullif_empty(c, k).isNull()).alias(c) for c, k in kinds.items()]
    one = df.agg(F.count("*").alias("n_rows"), *missing)
    long = one.unpivot("n_rows", list(kinds), "column_name", "n_missing")
    return long.select("column_name", "n_rows", "n_missing", digits(safe_ratio((F.col("n_rows") - F.col("n_missing")) * 100.0, "n_rows")).alias("pct_present"))


def consistency(df: DataFrame, by: list[str], a: Column, b: Column, tolerance: float) -> DataFrame:
    """n, n_equal, rate of rows whose two values differ by the tolerance at most; rows with a null don't count."""
    both = a.isNotNull() & b.isNotNull()
    return df.where(both).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.abs(a - b) <= tolerance).alias("n_equal")).withColumn("rate", digits(safe_ratio("n_equal", "n")))


def outliers(df: DataFrame, by: list[str], value: str, key: str, n: int) -> DataFrame:
    """The n largest (side top) and smallest (side bottom) of each group, ties by key. Nulls have no place.

    Each task first keeps its own n of every group, so groups of any size are cheap to rank.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, key, value)

    def side(name: str, order: Column) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order, F.col(key))
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("side", F.lit(name))

    return side("top", F.desc(value)).unionByName(side("bottom", F.asc(value)))


def weighted_score(df: DataFrame, parts: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row: the share of rows meeting each condition, and their weighted sum in per cent."""
    shares = df.agg(*[F.avg(F.coalesce(c.cast("double"), F.lit(0.0))).alias(k) for k, (c, _) in parts.items()])
    total = sum(F.coalesce(F.col(k), F.lit(0.0)) * w for k, (_, w) in parts.items())
    return shares.select(*[digits(F.coalesce(F.col(k), F.lit(0.0))).alias(k) for k in parts], digits(total * 100.0).alias("score"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0 below the range, bins + 1 above), n: data of a plot."""
    return df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
