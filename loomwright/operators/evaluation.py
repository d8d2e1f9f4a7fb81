"""Evaluation of classification and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions.numeric import digits, gain, safe_ratio


def class_metrics(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 of every label given or predicted; rows with null gold don't count."""
    d = df.where(F.col(gold).isNotNull())
    g = d.groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("g"), F.count_if(F.col(gold) == F.col(predicted)).alias("tp"))
    p = d.where(F.col(predicted).isNotNull()).groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("p"))
    j = g.join(p, "label", "full").fillna(0, ["g", "tp", "p"])
    m = j.select("label", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), safe_ratio("tp", "p").alias("precision"), safe_ratio("tp", "g").alias("recall"))
    return m.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(metrics: DataFrame) -> DataFrame:
    """One row: mean F1 over labels that occur in gold, and the share of right predictions."""
    gold = F.col("tp") + F.col("fn")
    return metrics.agg(F.avg(F.when(gold > 0, F.col("f1"))).alias("macro_f1"), safe_ratio(F.sum("tp"), F.sum(gold)).alias("accuracy"))


def confusions(df: DataFrame, gold: str, predicted: str, top: int = 15) -> DataFrame:
    wrong = df.where(F.col(gold) != F.col(predicted)).groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "gold", "predicted").limit(top)


def retrieval_metrics(ranked: DataFrame, k: int = 5) -> DataFrame:
    """query_id, hit@1, hit@3, hit@k, precision@k, reciprocal rank, NDCG@k from (query_id, rank, relevant).

    Precision divides by the results there are, k at most; the ideal order is that of the results retrieved.
    """
    r = ranked.where(F.col("rank") <= k).withColumn("rel", F.col("relevant").cast("int"))
    ideal = Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank")
    r = r.withColumn("best", F.row_number().over(ideal))
    hit = lambda n: F.max(F.when(F.col("rank") <= n, F.col("rel")).otherwise(0))
    out = r.groupBy("query_id").agg(
        hit(1).alias("hit1"), hit(3).alias("hit3"), hit(k).alias("hitk"), safe_ratio(F.sum("rel"), F.count("*")).alias("precision"),
        F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"),
        safe_ratio(F.sum(gain("rel", "rank")), F.sum(gain("rel", "best"))).alias("ndcg"),
    )
    return out


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    """n, mean, population deviation, share below zero, 95th percentile."""
    return df.agg(F.count(score).alias("n"), digits(F.avg(score)).alias("mean"), digits(F.stddev_pop(score)).alias("std"), digits(F.avg((F.col(score) < 0).cast("double"))).alias("negative"), digits(F.percentile(score, F.lit(0.95))).alias("p95"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of both runs and their difference."""
    x, y = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return x.join(y, key, "full").withColumn("delta", F.col("b") - F.col("a"))
