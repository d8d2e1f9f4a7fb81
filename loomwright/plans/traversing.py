"""Queries that serve from the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import graph as G
from loomwright.operators import traversal as T
from loomwright.plans.base import Registry, Tables
from loomwright.plans.searching import EDGES, WAY, _edges, _nodes

query = Registry()
TRADE = """x AS (SELECT 'nation:' || c_nationkey AS src, 'nation:' || s_nationkey AS dst, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


def _trade(t: Tables):
    """Edges from the buyers' nation to the suppliers', with the number of items and their quantity."""
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.groupBy(F.concat(F.lit("nation:"), "c_nationkey").alias("a"), F.concat(F.lit("nation:"), "s_nationkey").alias("b")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("qty"))
    return T.property_edges((rows, "a", "b", "BUYS_FROM", {"n": "n", "qty": "qty"}, None))


@query(f"WITH {TRADE} SELECT src || '_BUYS_FROM_' || dst AS edge_id, src, dst, 'BUYS_FROM' AS type, n, qty FROM x")
def property_edges(t: Tables):
    return _trade(t).select("edge_id", "src", "dst", "type", T.prop("n", "bigint").alias("n"), T.prop("qty").alias("qty"))


@query("SELECT 'nation:' || n_nationkey || '_PART_OF_region:' || n_regionkey || '_' || lower(n_name) AS edge_id, n_name AS name FROM nation")
def qualified_edge_ids(t: Tables):
    rows = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("a"), F.concat(F.lit("region:"), "n_regionkey").alias("b"), F.lower("n_name").alias("stage"), F.lit("older").alias("old"), "n_name")
    return T.property_edges((rows, "a", "b", "PART_OF", {"name": "old"}, "stage"), (rows, "a", "b", "PART_OF", {"name": "n_name"}, "stage")).select("edge_id", T.prop("name", "string").alias("name"))


@query(f"WITH {TRADE} SELECT * FROM (SELECT src AS id, dst AS other, qty, row_number() OVER (PARTITION BY src ORDER BY qty DESC, dst) AS rank FROM x) WHERE rank <= 10")
def graph_top_out(t: Tables):
    return T.top_related(_trade(t), "BUYS_FROM", "qty")


@query(f"WITH {TRADE} SELECT * FROM (SELECT dst AS id, src AS other, n * 1.0::DOUBLE AS n, row_number() OVER (PARTITION BY dst ORDER BY n DESC, src) AS rank FROM x) WHERE rank <= 2")
def graph_top_in(t: Tables):
    return T.top_related(_trade(t), "BUYS_FROM", "n", 2, "in")


@query(f"""WITH {TRADE}, p AS (SELECT 'nation:' || a.n_nationkey AS a, 'nation:' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
big AS (SELECT * FROM x WHERE qty > (SELECT avg(qty) FROM x))
SELECT p.a, p.b, CASE WHEN f.src IS NOT NULL OR g.src IS NOT NULL THEN 'BUYS_FROM' END AS type, CASE WHEN f.src IS NOT NULL THEN false WHEN g.src IS NOT NULL THEN true END AS reversed, coalesce(f.qty, g.qty) AS qty
FROM p LEFT JOIN big f ON f.src = p.a AND f.dst = p.b LEFT JOIN big g ON g.src = p.b AND g.dst = p.a""")
def graph_head_to_head(t: Tables):
    n = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), "n_nationkey", "n_regionkey")
    pairs = n.alias("x").join(n.alias("y"), (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") < F.col("y.n_nationkey"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    e = _trade(t)
    mean = e.agg(F.avg(T.prop("qty")).alias("mean"))
    big = e.join(F.broadcast(mean)).where(T.prop("qty") > F.col("mean")).drop("mean")  # one row
    return T.head_to_head(big, pairs, ["BUYS_FROM"]).select("a", "b", "type", "reversed", T.prop("qty").alias("qty"))


@query(f"WITH {TRADE}, c AS (SELECT unnest(['nation:1', 'nation:2', 'nation:3']) AS id) SELECT c.id, n_name AS name, x.dst AS other, x.qty FROM c JOIN nation ON c.id = 'nation:' || n_nationkey LEFT JOIN x ON x.src = c.id AND x.dst IN (SELECT id FROM c)")
def graph_comparison(t: Tables):
    """Names of up to three nodes, with the edges among them."""
    ids = t.spark.createDataFrame([(f"nation:{k}",) for k in (1, 2, 3)], "id string")
    among = T.subgraph(_trade(t), ids).select(F.col("src").alias("id"), F.col("dst").alias("other"), T.prop("qty").alias("qty"))
    return _nodes(t).join(ids, "id", "left_semi").select("id", T.prop("name", "string").alias("name")).join(among, "id", "left")


@query("""WITH v AS (SELECT unnest(['germany', ' Supplier#000000003 ', 'region:2', 'nobody']) AS value),
k AS (SELECT 'nation:' || n_nationkey AS id, lower(n_name) AS name FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, lower(s_name) FROM supplier UNION ALL SELECT 'region:' || r_regionkey, lower(r_name) FROM region UNION ALL SELECT 'customer:' || c_custkey, lower(c_name) FROM customer)
SELECT DISTINCT value, id FROM v LEFT JOIN k ON k.name = lower(trim(value)) OR k.id = lower(trim(value))""")
def graph_lookup(t: Tables):
    return T.lookup(_nodes(t), t.spark.createDataFrame([("germany",), (" Supplier#000000003 ",), ("region:2",), ("nobody",)], "value string"), ["name"])


TAGGED = "g AS (SELECT DISTINCT l_suppkey AS s, 'type:' || p_type AS tag FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _tagged(t: Tables):
    of = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.concat(F.lit("supplier:"), "l_suppkey").alias("src"), F.concat(F.lit("type:"), "p_type").alias("dst"), F.lit("HAS_TYPE").alias("type"))
    return of.unionByName(_edges(t).where("type = 'SITS_IN'"))


@query(f"WITH {TAGGED}, y AS (SELECT DISTINCT 'type:' || p_type AS tag FROM part ORDER BY 1 LIMIT 3) SELECT 'supplier:' || s AS id, count(DISTINCT tag) AS n_tags FROM g WHERE tag IN (SELECT tag FROM y) GROUP BY 1 HAVING count(DISTINCT tag) = 3")
def graph_with_all_tags(t: Tables):
    tags = [f"type:{r[0]}" for r in t.part.select("p_type").distinct().orderBy("p_type").limit(3).collect()]
    return T.with_tags(_tagged(t), "HAS_TYPE", tags, every=True)


@query(f"WITH {TAGGED}, y AS (SELECT DISTINCT 'type:' || p_type AS tag FROM part ORDER BY 1 LIMIT 3) SELECT 'supplier:' || s AS id, count(DISTINCT tag) AS n_tags FROM g JOIN supplier ON s_suppkey = s AND s_nationkey = 3 WHERE tag IN (SELECT tag FROM y) GROUP BY 1")
def graph_role_counter(t: Tables):
    tags = [f"type:{r[0]}" for r in t.part.select("p_type").distinct().orderBy("p_type").limit(3).collect()]
    return T.role_counters(_tagged(t), "SITS_IN", "nation:3", "HAS_TYPE", tags)


@query(f"WITH {EDGES}, {WAY}, i AS (SELECT 'region:1' AS id UNION SELECT b FROM w WHERE a = 'region:1' UNION SELECT v.b FROM w u JOIN w v ON u.b = v.a WHERE u.a = 'region:1') SELECT src, dst, type FROM e WHERE src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i)")
def graph_subgraph(t: Tables):
    e = _edges(t)
    return T.subgraph(e, G.within_hops(e, t.spark.createDataFrame([("region:1",)], "id string"), 2)).select("src", "dst", "type")


@query(f"WITH {EDGES} SELECT id, type FROM (SELECT src AS id, type FROM e WHERE dst = 'nation:3' UNION SELECT dst, type FROM e WHERE src = 'nation:3') ORDER BY id, type LIMIT 5")
def graph_neighbours_first(t: Tables):
    return G.neighbours(_edges(t), "nation:3", most=5)


@query(f"""WITH {TRADE}, q AS (SELECT o_orderkey AS key, o_orderpriority AS intent, 'nation:' || c_nationkey AS entity FROM orders JOIN customer ON c_custkey = o_custkey),
best AS (SELECT src, max_by(dst, (qty, -length(dst), dst)) AS d, max(qty) AS m FROM x GROUP BY 1),
top AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY qty DESC, dst) r FROM x) WHERE r = 1),
a AS (SELECT key, dst AS answer, '1-URGENT' AS strategy FROM q JOIN top ON src = entity WHERE intent = '1-URGENT' UNION ALL
SELECT key, r_name, '2-HIGH' FROM q JOIN nation ON entity = 'nation:' || n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE intent = '2-HIGH' AND r_name LIKE 'A%'),
b AS (SELECT key, n_name AS answer, 'overview' AS strategy FROM q JOIN nation ON entity = 'nation:' || n_nationkey WHERE key NOT IN (SELECT key FROM a) AND n_nationkey < 20)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT key, NULL, 'none' FROM q WHERE key NOT IN (SELECT key FROM a) AND key NOT IN (SELECT key FROM b)""")
def graph_dispatch(t: Tables):
    """Requests answered by intent, then by an overview of their entity, else by nothing."""
    ask = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("intent"), F.concat(F.lit("nation:"), "c_nationkey").alias("entity"))
    nation = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("entity"), "n_nationkey", "n_name", "n_regionkey")
    top = T.top_related(_trade(t), "BUYS_FROM", "qty", 1).select(F.col("id").alias("entity"), F.col("other").alias("answer"))
    region = nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name like 'A%'").select("entity", F.col("r_name").alias("answer"))
    handlers = {"1-URGENT": lambda q: q.join(top, "entity").select("key", "answer"), "2-HIGH": lambda q: q.join(region, "entity").select("key", "answer")}
    overview = lambda q: q.join(nation.where("n_nationkey < 20"), "entity").select("key", F.col("n_name").alias("answer"))
    return T.answer(ask, "key", "intent", handlers, [("overview", overview)])


LAYERS = """w AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
h0 AS (SELECT 's1' AS id, 0 AS hops, 's1' AS path), h1 AS (SELECT b AS id, 1 AS hops, min(path || ' ' || b) AS path FROM h0 JOIN w ON a = id GROUP BY b),
h2 AS (SELECT b AS id, 2 AS hops, min(path || ' ' || b) AS path FROM h1 JOIN w ON a = id WHERE b <> 's1' GROUP BY b)"""


@query(f"WITH {LAYERS} SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2")
def shortest_path_nodes(t: Tables):
    e = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()
    return G.shortest_paths(e, "s1", 2).select("id", "hops", F.array_join("path", " ").alias("path"))
