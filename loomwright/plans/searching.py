"""Queries on the graph and on retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import numeric as N
from loomwright.operators import graph as G
from loomwright.operators import joins as J
from loomwright.operators import pipeline as PL
from loomwright.operators import retrieval as V
from loomwright.operators import rules as R
from loomwright.plans.base import Registry, Tables, r4
from loomwright.session import shared_dir

query = Registry()
EDGES = """e AS (SELECT DISTINCT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'LIVES_IN' AS type FROM customer UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'SITS_IN' FROM supplier
UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF' FROM nation UNION SELECT 'customer:' || o_custkey, 'priority:' || o_orderpriority, 'ORDERS_AS' FROM orders)"""
WAY = "w AS (SELECT src a, dst b FROM e UNION SELECT dst, src FROM e)"


def _edges(t: Tables):
    return G.edges(
        (t.customer, "c_custkey", "customer", "c_nationkey", "nation", "LIVES_IN"), (t.supplier, "s_suppkey", "supplier", "s_nationkey", "nation", "SITS_IN"),
        (t.nation, "n_nationkey", "nation", "n_regionkey", "region", "PART_OF"), (t.orders, "o_custkey", "customer", "o_orderpriority", "priority", "ORDERS_AS"),
    )


def _nodes(t: Tables):
    return G.nodes(
        (t.customer, "c_custkey", "customer", {"name": "c_name", "segment": "c_mktsegment"}), (t.supplier, "s_suppkey", "supplier", {"name": "s_name"}),
        (t.nation, "n_nationkey", "nation", {"name": "n_name"}), (t.region, "r_regionkey", "region", {"name": "r_name"}),
    )


@query(f"WITH {EDGES} SELECT * FROM e")
def typed_edges(t: Tables):
    return _edges(t)


@query("""SELECT 'customer:' || c_custkey AS id, 'customer' AS label, c_name AS name FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name FROM region""")
def graph_nodes(t: Tables):
    return _nodes(t).select("id", "label", F.try_element_at("props", F.lit("name")).alias("name"))


@query(f"WITH {EDGES} SELECT * FROM e WHERE type <> 'ORDERS_AS' AND (split_part(dst, ':', 1) <> 'nation' OR dst IN (SELECT 'nation:' || n_nationkey FROM nation))")
def graph_known_ends(t: Tables):
    return G.with_ends(_edges(t), _nodes(t))


@query(f"WITH {EDGES}, {WAY} SELECT a AS id, count(*) AS degree FROM w GROUP BY 1")
def graph_undirected_edges(t: Tables):
    return G.degrees(_edges(t))


@query(f"WITH {EDGES} SELECT 'edge' AS kind, type AS name, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'node', 'customer', count(*) FROM customer UNION ALL SELECT 'node', 'supplier', count(*) FROM supplier UNION ALL SELECT 'node', 'nation', count(*) FROM nation UNION ALL SELECT 'node', 'region', count(*) FROM region")
def graph_stats(t: Tables):
    return G.counts(_nodes(t), _edges(t))


@query(f"WITH {EDGES} SELECT DISTINCT dst AS id, type FROM e WHERE src = 'nation:3' UNION SELECT src, type FROM e WHERE dst = 'nation:3'")
def graph_neighbours(t: Tables):
    return G.neighbours(_edges(t), "nation:3")


@query(f"WITH RECURSIVE {EDGES}, {WAY}, h AS (SELECT 'supplier:1' AS id, 0 AS hops UNION SELECT b, hops + 1 FROM h JOIN w ON a = id WHERE hops < 2) SELECT id, min(hops) AS hops FROM h GROUP BY 1")
def khop_neighborhood(t: Tables):
    return G.within_hops(_edges(t), t.spark.createDataFrame([("supplier:1",)], "id string"), 2)


@query("""WITH RECURSIVE w AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
h AS (SELECT 's1' AS id, 0 AS hops UNION SELECT b, hops + 1 FROM h JOIN w ON a = id WHERE hops < 3) SELECT id, min(hops) AS hops, min(hops) + 1 AS n_nodes FROM h GROUP BY 1""")
def shortest_path(t: Tables):
    e = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()
    return G.shortest_paths(e, "s1", 3).select("id", "hops", F.size("path").alias("n_nodes"))


@query("""WITH a AS (SELECT o_custkey k, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) p FROM orders GROUP BY 1), b AS (SELECT o_custkey k, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) s FROM orders GROUP BY 1)
SELECT 'customer:' || c_custkey AS id, coalesce(p, '') AS priorities, coalesce(s, '') AS statuses FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def optional_neighbors(t: Tables):
    src = F.concat_ws(":", F.lit("customer"), F.col("o_custkey").cast("string")).alias("src")
    e = t.orders.select(src, F.col("o_orderpriority").alias("dst"), F.lit("priorities").alias("type")).union(t.orders.select(src, "o_orderstatus", F.lit("statuses")))
    base = t.customer.select(F.concat_ws(":", F.lit("customer"), F.col("c_custkey").cast("string")).alias("id"))
    out = G.optional_sets(base, "id", e, ["priorities", "statuses"])
    return out.select("id", F.array_join("priorities", ",").alias("priorities"), F.array_join("statuses", ",").alias("statuses"))


WORDS_SQL = "SELECT DISTINCT i.item_id, w.word FROM (SELECT item_id, unnest(string_split_regex(lower(passage), '[^a-z]+')) AS word FROM eval_items) w JOIN eval_items i ON i.item_id = w.item_id WHERE length(w.word) >= 8"


@query(f"""WITH dict AS (SELECT word, min(item_id) AS entity FROM ({WORDS_SQL}) GROUP BY 1), d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents)
SELECT doc_id, word, entity FROM (SELECT doc_id, word, entity, row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, word) r FROM d JOIN dict USING (word)) WHERE r <= 3""")
def text_entity_match(t: Tables):
    split = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), "[^a-z]+"))).alias("word")
    names = t.eval_items.select("item_id", split("passage")).where("length(word) >= 8").groupBy("word").agg(F.min("item_id").alias("entity"))
    found = t.documents.select("doc_id", split("text")).join(names, "word")
    return J.top_n(found, ["doc_id"], [F.desc(F.length("word")), F.col("word")], 3).select("doc_id", "word", "entity")


QV = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
ALL = "s AS (SELECT query_id, id, c.label, q.label AS ql, list_inner_product(q.v, c.v) AS score FROM q, c)"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT"


def _vectors(t: Tables):
    e = t.embeddings
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def _shown(df):
    return df.withColumn("score", N.digits("score", 6))


@query(f"WITH {QV}, {ALL} SELECT query_id, id, {r4('score', 6)} AS score, rank FROM (SELECT *, {RANK} AS rank FROM s) WHERE rank <= 10")
def vector_topk(t: Tables):
    return _shown(V.topk(*_vectors(t), 10))


@query(f"WITH {QV}, {ALL} SELECT query_id, id, {r4('score', 6)} AS score, rank FROM (SELECT *, {RANK} AS rank FROM s WHERE label % 2 = 1) WHERE rank <= 5")
def vector_topk_filtered(t: Tables):
    c, q = _vectors(t)
    return _shown(V.topk_filtered(c, q, 5, F.col("label") % 2 == 1))


@query(f"WITH {QV}, {ALL}, o AS (SELECT *, {RANK} AS r FROM s) SELECT query_id, id, {r4('score', 6)} AS score, rank FROM (SELECT *, {RANK} AS rank FROM o WHERE r <= 15 AND label % 2 = 1) WHERE rank <= 5")
def vector_topk_overfetch(t: Tables):
    c, q = _vectors(t)
    return _shown(V.topk_filtered(c, q, 5, F.col("label") % 2 == 1, overfetch=3))


@query(f"WITH {QV}, {ALL}, o AS (SELECT *, {RANK} AS r FROM s), b AS (SELECT query_id, id, score * CASE WHEN label = 3 THEN 1.3 ELSE 1.0 END * CASE WHEN id % 2 = 0 THEN 1.15 ELSE 1.0 END AS score FROM o WHERE r <= 30) SELECT query_id, id, {r4('score', 6)} AS score, rank FROM (SELECT *, {RANK} AS rank FROM b) WHERE rank <= 10")
def vector_boosted(t: Tables):
    c, q = _vectors(t)
    wide = V.topk(c, q, 30).join(c.select("id", "label"), "id")
    return _shown(V.boosted(wide, [(F.col("label") == 3, 1.3), (F.col("id") % 2 == 0, 1.15)], 10)).select("query_id", "id", "score", "rank")


TWO = f"""{QV}, {ALL}, a AS (SELECT query_id, id, rank FROM (SELECT *, {RANK} AS rank FROM s) WHERE rank <= 10),
h AS (SELECT query_id, id, list_inner_product(q.v[1:32], c.v[1:32]) AS score FROM q, c), b AS (SELECT query_id, id, rank FROM (SELECT *, {RANK} AS rank FROM h) WHERE rank <= 10)"""


def _two(t: Tables):
    c, q = _vectors(t)
    half = lambda d: d.withColumn("vec", F.slice("vec", 1, 32))
    return V.topk(c, q, 10), V.topk(half(c), half(q), 10)


@query(f"WITH {TWO}, f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, string_agg(l, '+' ORDER BY l) AS sources FROM (SELECT *, 'full' AS l FROM a UNION ALL SELECT *, 'half' FROM b) GROUP BY 1, 2) SELECT query_id, id AS key, {r4('score', 6)} AS score, sources, rank FROM (SELECT *, {RANK} AS rank FROM f) WHERE rank <= 10")
def rrf_fusion(t: Tables):
    a, b = _two(t)
    return _shown(V.fuse({"full": a, "half": b}, top=10))


@query(f"WITH {QV}, {ALL} SELECT query_id, id AS key, {r4('score', 6)} AS score, 'full' AS sources, rank FROM (SELECT *, {RANK} AS rank FROM s) WHERE rank <= 10")
def hybrid_single_side(t: Tables):
    c, q = _vectors(t)
    return _shown(V.fuse({"full": V.topk(c, q, 10), "none": V.topk(c.where("false"), q, 10)}, top=10))


@query(f"WITH {QV}, {ALL}, o AS (SELECT *, {RANK} AS r FROM s) SELECT query_id, id, {r4('1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, score))))', 6)} AS score, rank FROM (SELECT query_id, id, score * 8 - (id % 7) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score * 8 - (id % 7) DESC, id)::INT AS rank FROM o WHERE r <= 15) WHERE rank <= 5")
def rerank_sigmoid(t: Tables):
    return _shown(V.rerank(V.topk(*_vectors(t), 15), F.col("score") * 8 - (F.col("id") % 7), 5))


@query("""SELECT entity_name, chunk_type, string_agg(chunk_id, chr(10) ORDER BY r) AS context FROM (SELECT *, row_number() OVER (PARTITION BY entity_name, chunk_type ORDER BY length(text) DESC, chunk_id) r FROM (SELECT DISTINCT chunk_id, entity_name, chunk_type, text FROM document_chunks) WHERE entity_name IS NOT NULL AND text IS NOT NULL AND chunk_type IS NOT NULL) WHERE r <= 3 GROUP BY 1, 2""")
def context_sections(t: Tables):
    rows = t.document_chunks.where("entity_name is not null and text is not null and chunk_type is not null").select("chunk_id", "entity_name", "chunk_type", "text").distinct()
    return V.sections(rows, ["entity_name"], "chunk_type", "chunk_id", [F.desc(F.length("text")), F.col("chunk_id")], 3)


@query(f"WITH {QV}, {ALL}, m AS (SELECT query_id, max(score) AS top FROM s WHERE id <> query_id GROUP BY 1) SELECT query_id, {r4('top', 6)} AS top, CASE WHEN top >= 0.3 THEN 'sufficient' ELSE 'insufficient' END AS gate FROM m")
def sufficiency_gate(t: Tables):
    best = V.topk(*_vectors(t), 2).where("id != query_id").groupBy("query_id").agg(F.max("score").alias("top"))
    return best.select("query_id", N.digits("top", 6).alias("top"), R.first_match([("sufficient", F.col("top") >= 0.3)], "insufficient").alias("gate"))


@query()
def ann_ivf(t: Tables):
    """Approximate search; tests hold it against vector_topk over the given tables (recall at least 0.9).

    The embeddings hardly cluster, so nearly all lists have to be searched for that.
    """
    c, q = _vectors(t)
    return _shown(V.Inverted(c.select("id", "vec"), 16).search(q, 10, 14))


@query()
def tfidf_encode(t: Tables):
    v = V.tfidf(t.documents, "doc_id", "text")
    return v.select("doc_id", N.digits(N.dot("vec", "vec"), 6).alias("norm"), F.size(F.filter("vec", lambda x: x != 0)).alias("n_terms"))


@query(f"""WITH {QV}, {ALL}, o AS (SELECT *, {RANK} AS r FROM s), i AS (SELECT *, CASE query_id % 200 WHEN 0 THEN 'STORY' ELSE 'SHOP' END AS intent, 't' || (id % 3) AS kind FROM o WHERE r <= 30),
n AS (SELECT query_id, id, score * CASE WHEN intent = 'STORY' AND kind = 't1' THEN 1.15 ELSE 1.0 END AS score FROM i WHERE NOT (intent = 'SHOP' AND kind IN ('t0', 't2')))
SELECT query_id, id, {r4('score', 6)} AS score, rank FROM (SELECT *, {RANK} AS rank FROM n) WHERE rank <= 10""")
def search_by_intent(t: Tables):
    c, q = _vectors(t)
    rows = c.select("id", F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("chunk_type"))
    intents = q.select("query_id", F.when(F.col("query_id") % 200 == 0, "STORY").otherwise("SHOP").alias("intent"))
    return _shown(PL.narrowed(V.topk(c, q, 30), rows, intents, {"STORY": "t1"}, {"SHOP": ["t0", "t2"]}, 10))


@query(f"""WITH {TWO}, k AS (SELECT vec_id AS id, 'e' || (vec_id % 9) || '::' || label AS key FROM embeddings), u AS (SELECT query_id, key, min(rank) AS rank FROM a JOIN k USING (id) GROUP BY 1, 2 UNION ALL SELECT query_id, key, min(rank) FROM b JOIN k USING (id) GROUP BY 1, 2),
f AS (SELECT query_id, key, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY 1, 2) SELECT query_id, key, {r4('score', 6)} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INT AS rank FROM f) WHERE rank <= 5""")
def fusion_by_type(t: Tables):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("e"), (F.col("vec_id") % 9).cast("string")).alias("entity_name"), F.col("label").cast("string").alias("chunk_type"), F.lit("").alias("text"))
    return _shown(PL.fused_by_type(list(_two(t)), rows, 5))


@query()
def retrieval_pipeline(t: Tables):
    """Chunks of the table indexed, stored, loaded and searched by the questions of the evaluation items."""
    path = shared_dir(t.spark, "index")
    PL.build(t.document_chunks, path)
    index, stats = PL.load(t.spark, path)
    asked = t.eval_items.select(F.col("item_id").alias("query_id"), "question", "intent")
    return _shown(PL.search(index, asked, 5, stats["size"], "Represent this question for searching passages: "))
