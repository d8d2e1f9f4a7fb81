"""Retrieval end to end: chunks to an index on disk, and from a query to re-ranked, typed results."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions.numeric import rrf
from loomwright.operators.retrieval import rerank, topk

WORD = r"[\p{L}\p{N}]+"


def _hashed(size: int):
    @F.arrow_udf("array<double>")
    def vectors(hashes: pa.Array) -> pa.Array:
        h = hashes.flatten().to_numpy(zero_copy_only=False).astype("int64")
        n = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False)
        cells = np.repeat(np.arange(len(n)), n) * size + h % size
        raw = np.bincount(cells, np.where((h >> 32) % 2 == 0, 1.0, -1.0), len(n) * size).reshape(len(n), size)
        norm = np.sqrt((raw * raw).sum(1))
        there = norm > 0
        flat = raw[there] / norm[there][:, None]
        ends = np.r_[0, np.cumsum(np.where(there, size, 0))].astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.ravel()), mask=pa.array(~there))

    return vectors


def encode(df: DataFrame, text: str, size: int = 256, prefix: str = "", out: str = "vec") -> DataFrame:
    """df with a unit vector of each text: its words and pairs of words hashed to ``size`` signed buckets.

    ``prefix`` goes before the text, as for instructions of queries. Texts without words and nulls have a null vector.
    Words are hashed inside the JVM; their sums are built for a whole Arrow batch at once, as built-in functions would
    walk all words of a text once a bucket.
    """
    words = F.regexp_extract_all(F.lower(F.concat(F.lit(prefix), F.col(text))), F.lit(WORD), F.lit(0))
    pairs = F.zip_with(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 1, F.lit(0))), F.slice("_words", 2, F.size("_words")), lambda a, b: F.concat_ws(" ", a, b))
    hashes = F.transform(F.concat("_words", pairs), lambda w: F.xxhash64(w))  # noqa: PLW0108
    return df.withColumn("_words", words).withColumn(out, _hashed(size)(hashes)).drop("_words")


def build(chunks: DataFrame, path: str, size: int = 256) -> dict:
    """Writes the index of chunks (chunk_id, entity_name, chunk_type, text) below path and returns its statistics.

    Rows of one chunk_id count once (the smallest text); blank texts are left out. The folder holds the rows with their
    vectors, parted by type, and ``stats`` (JSON): n, size, and n of each type. An index there before is replaced.
    """
    spark = chunks.sparkSession
    one = chunks.where("chunk_id is not null and trim(text) != ''").groupBy("chunk_id").agg(F.min(F.struct("text", "entity_name", F.lower(F.trim("chunk_type")).alias("chunk_type"))).alias("c")).select("chunk_id", "c.*")
    encode(one, "text", size).where("vec is not null").withColumn("part", F.coalesce(F.nullif("chunk_type", F.lit("")), F.lit("none"))).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    kinds = {r["part"]: r["n"] for r in spark.read.parquet(f"{path}/rows").groupBy("part").agg(F.count("*").alias("n")).collect()} if _any(spark, path) else {}
    stats = {"n": sum(kinds.values()), "size": size, "types": dict(sorted(kinds.items()))}
    spark.createDataFrame([(json.dumps(stats),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stats")
    return stats


def _any(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/part=*")
    return len(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []) > 0


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Rows and statistics of an index; raises where the rows aren't as many as it was written with."""
    stats = json.loads(spark.read.text(f"{path}/stats").first()["value"])
    schema = "chunk_id string, text string, entity_name string, chunk_type string, vec array<double>, part string"
    rows = spark.read.schema(schema).parquet(f"{path}/rows") if stats["n"] else spark.createDataFrame([], schema)
    if (n := rows.count()) != stats["n"]:
        raise ValueError(f"{path} holds {n} rows, not {stats['n']}")
    return rows.drop("part"), stats


def lexical(query: str, text: str) -> Column:
    """Share of the query's different words that the text holds."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(WORD), F.lit(0)))
    return F.size(F.array_intersect(words(query), words(text))) / F.greatest(F.size(words(query)), F.lit(1))


def narrowed(ranked: DataFrame, rows: DataFrame, intents: DataFrame, prefer: dict[str, str], exclude: dict[str, list[str]], k: int, factor: float = 1.15) -> DataFrame:
    """query_id, id, score, rank after the wishes of each query's intent: excluded types go, the preferred type gains.

    ``rows``: id, chunk_type; ``intents``: query_id, intent. Intents without an entry change nothing.
    """
    r = ranked.drop("rank").join(rows.select("id", "chunk_type"), "id").join(intents, "query_id", "left")
    hit = lambda pairs: F.coalesce(F.reduce(F.array(*[(F.col("intent") == i) & (F.col("chunk_type") == c) for i, c in pairs]), F.lit(False), lambda a, x: a | F.coalesce(x, F.lit(False))), F.lit(False)) if pairs else F.lit(False)
    r = r.where(~hit([(i, c) for i, cs in exclude.items() for c in cs])).withColumn("score", F.col("score") * F.when(hit(list(prefer.items())), factor).otherwise(1.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def fused_by_type(lists: list[DataFrame], rows: DataFrame, k: int) -> DataFrame:
    """query_id, key, score, rank: reciprocal-rank fusion where chunks of one entity and type are one.

    ``rows``: id, entity_name, chunk_type, text. The key is entity::chunk_type, or the start of the text without both.
    """
    key = F.when(F.col("entity_name").isNotNull() & F.col("chunk_type").isNotNull(), F.concat_ws("::", "entity_name", "chunk_type")).otherwise(F.substring("text", 1, 100))
    keys = rows.select("id", key.alias("key"))
    parts = [d.select("query_id", "id", "rank").join(keys, "id").groupBy("query_id", "key").agg(F.min("rank").alias("rank")) for d in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return every.groupBy("query_id", "key").agg(F.sum(rrf("rank")).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = 5, size: int = 256, prefix: str = "", prefer: dict[str, str] | None = None, exclude: dict[str, list[str]] | None = None) -> DataFrame:
    """query_id, id, score, rank: encode the queries, fetch 3 k chunks each, follow their intents, re-rank by words, cut at k.

    ``queries``: query_id, question, intent. Blank questions have no results.
    """
    q = encode(queries, "question", size, prefix)
    rows = index.withColumnRenamed("chunk_id", "id")
    wide = topk(rows.select("id", "vec"), q.select("query_id", "vec"), 3 * k)
    near = narrowed(wide, rows, queries.select("query_id", "intent"), prefer or {}, exclude or {}, 3 * k)
    texts = near.join(rows.select("id", "text"), "id").join(queries.select("query_id", "question"), "query_id")
    return rerank(texts, F.col("score") + 4 * lexical("question", "text"), k)
