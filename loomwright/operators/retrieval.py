"""Vector search, fusion of ranked lists, re-ranking and context assembly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions.numeric import rrf, sigmoid

#: Query vectors that a task holds at once; more are searched in further passes.
BLOCK = 20_000


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def topk(corpus: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, id, score, rank: the k nearest rows of the corpus by inner product, ties by id.

    ``corpus``: id, vec; ``queries``: query_id, vec; rows with a null vector are left out. Queries go in blocks of a
    fixed size to every task, which multiplies them with its batches of rows and keeps k a query over all of them;
    only those are shuffled. Exact; rows whose score is NaN are left out.
    """
    q = queries.where("vec is not null").select("query_id", "vec")
    n = q.count()
    passes = -(-n // block) or 1
    parts = []
    for p in range(passes):
        own = q if passes == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        table = own.toArrow()
        ids, kind, matrix = np.array(table.column(0).to_pylist()), table.column(0).type, _matrix(table.column(1).combine_chunks())
        if not len(ids):
            continue

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, matrix: np.ndarray = matrix, kind: pa.DataType = kind) -> Iterator[pa.RecordBatch]:
            held, id_kind = None, None  # query row, key, score of the best k so far
            for b in batches:
                keys, rows = np.array(b.column(0).to_pylist()), _matrix(b.column(1))
                if not len(keys):
                    continue
                id_kind, parts = b.column(0).type, [held] if held else []
                for at in range(0, len(ids), 512):
                    scores = matrix[at : at + 512] @ rows.T
                    least = np.partition(scores, -k, axis=1)[:, -k] if k < len(keys) else np.full(len(scores), -np.inf)
                    who, col = np.nonzero(scores >= least[:, None])
                    parts.append((who + at, keys[col], scores[who, col]))
                who, key, score = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((key, -score, who))
                who = who[order]
                first = np.searchsorted(who, who)
                keep = order[np.arange(len(who)) - first < k]
                held = tuple(np.concatenate(x)[keep] for x in zip(*parts, strict=True))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]], kind), pa.array(held[1], id_kind), pa.array(held[2])], ["query_id", "id", "score"])

        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, score double"
        parts.append(corpus.where("vec is not null").select("id", "vec").mapInArrow(run, kinds))
    if not parts:
        return corpus.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_filtered(corpus: DataFrame, queries: DataFrame, k: int, condition: Column, overfetch: int | None = None) -> DataFrame:
    """As topk over rows meeting the condition. ``overfetch``: instead search all, k * overfetch, and filter then,
    which may give fewer than k."""
    if not overfetch:
        return topk(corpus.where(condition), queries, k)
    got = topk(corpus, queries, k * overfetch).drop("rank").join(corpus.where(condition).select("id"), "id", "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def boosted(ranked: DataFrame, factors: list[tuple[Column, float]], k: int) -> DataFrame:
    """Scores times every factor whose condition holds, ranked anew and cut at k."""
    score = F.col("score")
    for condition, by in factors:
        score = score * F.when(F.coalesce(condition, F.lit(False)), F.lit(by)).otherwise(1.0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return ranked.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(lists: dict[str, DataFrame], key: str = "id", k: int = 60, top: int | None = None) -> DataFrame:
    """query_id, key, score, sources, rank: reciprocal-rank fusion of lists (query_id, id, rank).

    A key that stands several times in one list adds each time. Where all lists but one are empty for a query, its
    rows keep their own score and order; ``sources`` names the lists.
    """
    rows = reduce(DataFrame.unionByName, [d.select("query_id", F.col(key).alias("key"), "rank", "score", F.lit(n).alias("source")) for n, d in lists.items()])
    side = rows.groupBy("query_id").agg(F.count_distinct("source").alias("n_sides"))
    fused = rows.groupBy("query_id", "key").agg(F.sum(rrf("rank")).alias("fused"), F.max("score").alias("own"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    out = fused.join(side, "query_id").withColumn("score", F.when(F.col("n_sides") == 1, F.col("own")).otherwise(F.col("fused")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    out = out.withColumn("rank", F.row_number().over(w)).select("query_id", "key", "score", "sources", "rank")
    return out.where(F.col("rank") <= top) if top else out


def rerank(ranked: DataFrame, logit: Column, top: int) -> DataFrame:
    """Order by another model's raw score and show it through a sigmoid; single candidates stay untouched."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("logit"), "id")
    out = ranked.withColumns({"logit": logit, "n": n}).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return out.select("query_id", "id", F.when(F.col("n") > 1, sigmoid("logit")).alias("score"), "rank")


def sections(rows: DataFrame, by: list[str], section: str, text: str, order: list[Column], most: int) -> DataFrame:
    """One text for each group and section: its first ``most`` rows in order, joined by line breaks."""
    w = Window.partitionBy(*by, section).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    joined = kept.groupBy(*by, section).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t")))).alias("a"))
    return joined.select(*by, section, F.array_join(F.transform("a", lambda x: x["t"]), "\n").alias("context"))


class Inverted:
    """Inverted-file index: rows by nearest centroid; a search looks into the nearest few lists only.

    Centroids are fitted by k-means on at most ``sample`` rows (smallest hashes of ids); every row is indexed.
    """

    def __init__(self, corpus: DataFrame, lists: int, sample: int = 20_000, rounds: int = 12) -> None:
        pick = corpus.where("vec is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "vec").toArrow()
        x = _matrix(pick.column(1).combine_chunks())
        rng = np.random.default_rng(0)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds):
            near = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
            for i in range(len(c)):
                if (near == i).any():
                    c[i] = x[near == i].mean(0)
        self.centroids = c
        self.rows = self._assign(corpus, "id", 1)

    def _assign(self, df: DataFrame, key: str, probes: int) -> DataFrame:
        c = self.centroids

        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()).astype("float64")
            return pd.Series(list(np.argsort(-(x @ c.T - (c**2).sum(1) / 2), axis=1)[:, :probes].astype("int32")))

        return df.where("vec is not null").select(key, "vec", F.explode(nearest("vec")).alias("list"))

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, id, score, rank over the rows of the ``probes`` nearest lists."""
        from loomwright.functions.numeric import dot

        q = self._assign(queries, "query_id", probes).withColumnRenamed("vec", "qvec")
        scored = q.join(self.rows, "list").select("query_id", "id", dot("qvec", "vec").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tfidf(docs: DataFrame, key: str, text: str, bits: int = 10) -> DataFrame:
    """key and a normalised hashed TF-IDF vector (array<double>) of each text; blank texts have a zero vector."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = docs.select(key, F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w"))
    tf = HashingTF(numFeatures=1 << bits, inputCol="w", outputCol="tf").transform(words)
    weighed = IDF(inputCol="tf", outputCol="x").fit(tf).transform(tf)
    return Normalizer(inputCol="x", outputCol="v").transform(weighed).select(key, vector_to_array("v").alias("vec"))
