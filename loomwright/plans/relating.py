"""Queries on joins, aggregations, ranking, set operations and rules that score."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import arrays as A
from loomwright.functions import numeric as N
from loomwright.functions.text import normalize_key
from loomwright.operators import joins as J
from loomwright.operators import rules as R
from loomwright.plans.base import Registry, Tables, r4

query = Registry()


@query("""WITH k AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation),
c AS (SELECT c_nationkey k, min(c_name) nm, max(c_mktsegment) seg FROM customer GROUP BY 1), s AS (SELECT s_nationkey k, min(s_name) nm FROM supplier GROUP BY 1)
SELECT k.k AS key, coalesce(s.nm, c.nm) AS name, c.seg AS segment, concat_ws('+', CASE WHEN c.k IS NOT NULL THEN 'customer' END, CASE WHEN s.k IS NOT NULL THEN 'supplier' END, CASE WHEN n_nationkey IS NOT NULL THEN 'nation' END) AS sources_seen
FROM k LEFT JOIN c ON c.k = k.k LEFT JOIN s ON s.k = k.k LEFT JOIN nation ON n_nationkey = k.k""")
def merge_precedence(t: Tables):
    c = t.customer.groupBy(F.col("c_nationkey").alias("key")).agg(F.min("c_name").alias("name"), F.max("c_mktsegment").alias("segment"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("key")).agg(F.min("s_name").alias("name"))
    n = t.nation.select(F.col("n_nationkey").alias("key"))
    return J.merge_by_precedence("key", {"customer": c, "supplier": s, "nation": n}, {"name": ["supplier", "customer"], "segment": ["customer"]})


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'NONE') AS segment, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS side FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'FURNITURE'")
def merge_left_default(t: Tables):
    c = t.customer.where("c_mktsegment <> 'FURNITURE'")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("NONE")).alias("segment"), F.when(F.col("c_acctbal") > 0, "credit").otherwise("debit").alias("side"))


@query("""WITH a AS (SELECT regexp_replace(lower(trim(p_name)), '[ ]', '', 'g') AS alias, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT p_partkey, coalesce(a.id, p_partkey) AS resolved FROM part LEFT JOIN a ON a.alias = regexp_replace(lower(trim(p_name)), '[ ]', '', 'g')""")
def alias_resolution(t: Tables):
    p = t.part.withColumn("norm", normalize_key("p_name"))
    return J.resolve_alias(p, "norm", p.select(F.col("norm").alias("alias"), F.col("p_partkey").alias("id")), F.col("p_partkey")).select("p_partkey", "resolved")


@query("""WITH n AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name), q AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS query FROM part UNION SELECT DISTINCT upper(p_name) FROM part UNION SELECT DISTINCT p_name FROM part),
m AS (SELECT query, id, CASE WHEN query = name THEN 1 WHEN lower(query) = lower(name) THEN 2 ELSE 3 END AS way FROM q JOIN n ON contains(lower(name), lower(query)))
SELECT query, id, way FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY way, id) r FROM m) WHERE r = 1""")
def alias_fuzzy_priority(t: Tables):
    names = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    q = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("query")).union(t.part.select(F.upper("p_name"))).union(t.part.select("p_name")).distinct()
    return J.fuzzy_lookup(q, names)


@query("SELECT count(*) AS n_all, count(*) FILTER (p_size > 5) AS n_sized, count(*) FILTER (p_size > 5 AND p_type <> 'PROMO') AS n_plain, count(*) FILTER (p_size > 5 AND p_type <> 'PROMO' AND p_retailprice < 1000) AS n_kept FROM part")
def item_filter_funnel(t: Tables):
    a, b, c = F.col("p_size") > 5, F.col("p_type") != "PROMO", F.col("p_retailprice") < 1000
    return t.part.agg(F.count("*").alias("n_all"), F.count_if(a).alias("n_sized"), F.count_if(a & b).alias("n_plain"), F.count_if(a & b & c).alias("n_kept"))


@query("""SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END) = 2
AND count(*) FILTER (o_orderstatus IN ('P', 'F')) > 0 AND count(*) FILTER (contains(lower(o_orderpriority), 'low')) > 0""")
def multi_criteria_filter(t: Tables):
    d = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    return d.where(A.has_all("p", ["1-URGENT", "2-HIGH"]) & A.has_any("s", ["P", "F"]) & A.any_contains("p", "LOW")).select("o_custkey")


ARCHETYPES = [("rich", "bal > 5000"), ("busy", "n >= 12"), ("urgent", "urgent * 3 >= n"), ("idle", "n = 0")]


@query("""WITH d AS (SELECT c_custkey, c_acctbal AS bal, count(o_orderkey) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
""" + " UNION ALL ".join(f"SELECT c_custkey, '{k}' AS label FROM d WHERE {e}" for k, e in ARCHETYPES))
def archetype_membership(t: Tables):
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    d = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("c_acctbal").alias("bal"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("urgent", F.lit(0)).alias("urgent"))
    return R.classify(d, ARCHETYPES).select("c_custkey", "label")


@query("SELECT l_orderkey, string_agg(p, ',' ORDER BY p) AS parts FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL')) GROUP BY l_orderkey")
def array_membership_filter(t: Tables):
    small = t.part.where("p_type = 'SMALL'").select("p_partkey")
    d = t.lineitem.join(small, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_partkey").distinct()
    return d.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("parts"))


@query("SELECT doc_id FROM documents WHERE source = 'wiki_mirror' OR NOT EXISTS (SELECT 1 FROM documents WHERE source = 'wiki_mirror')")
def fallback_if_empty(t: Tables):
    return J.or_all(t.documents.select("doc_id", "source"), F.coalesce(F.col("source") == "wiki_mirror", F.lit(False))).select("doc_id")


@query("SELECT n_nationkey AS a, n AS b, score::DOUBLE AS score, reason FROM (SELECT x.n_nationkey, y.n_nationkey n, (CASE WHEN x.n_regionkey = y.n_regionkey THEN 3.0 ELSE 0.0 END) + (CASE WHEN left(x.n_name, 1) = left(y.n_name, 1) THEN 2.0 ELSE 0.0 END) + (CASE WHEN length(x.n_name) > length(y.n_name) THEN 1.0 ELSE 0.0 END) AS score, concat_ws('; ', CASE WHEN x.n_regionkey = y.n_regionkey THEN 'same region' END, CASE WHEN left(x.n_name, 1) = left(y.n_name, 1) THEN 'same letter' END, CASE WHEN length(x.n_name) > length(y.n_name) AND NOT (x.n_regionkey = y.n_regionkey AND left(x.n_name, 1) = left(y.n_name, 1)) THEN 'longer name' END) AS reason, row_number() OVER (PARTITION BY x.n_nationkey ORDER BY (CASE WHEN x.n_regionkey = y.n_regionkey THEN 3.0 ELSE 0.0 END) + (CASE WHEN left(x.n_name, 1) = left(y.n_name, 1) THEN 2.0 ELSE 0.0 END) + (CASE WHEN length(x.n_name) > length(y.n_name) THEN 1.0 ELSE 0.0 END) DESC, y.n_nationkey) r FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey) WHERE r <= 5 AND score > 0")
def pair_score_blocked(t: Tables):
    pairs = J.blocked_pairs(t.nation.withColumn("block", F.col("n_regionkey")), "n_nationkey", "block", ["n_name", "n_regionkey"])
    rules = [
        (F.col("a_n_regionkey") == F.col("b_n_regionkey"), 3.0, "same region"),
        (F.substring("a_n_name", 1, 1) == F.substring("b_n_name", 1, 1), 2.0, "same letter"),
        (F.length("a_n_name") > F.length("b_n_name"), 1.0, "longer name"),
    ]
    total, reason = R.score(rules)
    scored = pairs.select(F.col("a_n_nationkey").alias("a"), F.col("b_n_nationkey").alias("b"), total.alias("score"), reason.alias("reason")).where("score > 0")
    return J.top_n(scored, ["a"], [F.desc("score"), F.col("b")], 5).select("a", "b", "score", "reason")


@query("""WITH s AS (SELECT x.s_suppkey a, y.s_suppkey b, (x.s_acctbal - y.s_acctbal) AS ab FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey)
SELECT CASE WHEN -ab > ab THEN b ELSE a END AS src, CASE WHEN -ab > ab THEN a ELSE b END AS dst, """ + r4("abs(ab)") + " AS lead FROM s")
def pair_best_direction(t: Tables):
    p = J.blocked_pairs(t.supplier, "s_suppkey", "s_nationkey", ["s_acctbal"]).where("a_s_suppkey < b_s_suppkey")
    ab = F.col("a_s_acctbal") - F.col("b_s_acctbal")
    turn = -ab > ab  # the other direction only if strictly better
    return p.select(F.when(turn, F.col("b_s_suppkey")).otherwise(F.col("a_s_suppkey")).alias("src"), F.when(turn, F.col("a_s_suppkey")).otherwise(F.col("b_s_suppkey")).alias("dst"), N.digits(F.abs(ab)).alias("lead"))


PAIRS = """d AS (SELECT l_orderkey, l_suppkey AS s, bool_or(l_returnflag = 'R') AS w FROM lineitem GROUP BY 1, 2),
p AS (SELECT x.s a, y.s b, count(*) games, count(*) FILTER (x.w AND y.w) wins FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.s < y.s GROUP BY 1, 2)"""


def _pairs(t: Tables):
    return J.basket_pairs(t.lineitem.withColumn("won", F.col("l_returnflag") == "R"), "l_orderkey", "l_suppkey", "won")


@query(f"WITH {PAIRS} SELECT * FROM p")
def pair_cooccurrence(t: Tables):
    return _pairs(t)


@query(f"WITH {PAIRS} SELECT a, b, {r4('(wins + 10.0) / (games + 20.0) * 100.0')} AS rate FROM p WHERE games >= 15")
def pair_smoothed_rate(t: Tables):
    return _pairs(t).where("games >= 15").select("a", "b", N.digits(N.smoothed_rate("wins", "games")).alias("rate"))


@query("""WITH b AS (SELECT l_orderkey, string_agg(DISTINCT l_linestatus || l_returnflag, '+' ORDER BY l_linestatus || l_returnflag) AS lineup FROM lineitem GROUP BY 1),
c AS (SELECT o_orderpriority AS pri, lineup, count(*) AS games, count(*) FILTER (o_orderstatus = 'F') AS wins FROM b JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT pri, lineup, games, wins, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pri ORDER BY games DESC, wins DESC, lineup) AS rank FROM c) WHERE rank <= 3""")
def lineup_topn(t: Tables):
    b = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_linestatus", "l_returnflag"))), "+").alias("lineup"))
    c = b.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderpriority").alias("pri"), "lineup").agg(F.count("*").alias("games"), F.count_if(F.col("o_orderstatus") == "F").alias("wins"))
    return J.top_n(c, ["pri"], [F.desc("games"), F.desc("wins"), F.col("lineup")], 3)


@query("""WITH base AS (SELECT o_custkey k, count(*) n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), emp AS (SELECT o_custkey k, count(*) n FROM orders GROUP BY 1 HAVING count(*) >= 12)
SELECT coalesce(emp.k, base.k) AS key, CASE WHEN emp.k IS NOT NULL THEN emp.n ELSE base.n END AS n FROM base FULL JOIN emp ON base.k = emp.k""")
def empirical_overlay(t: Tables):
    base = t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    emp = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n")).where("n >= 12")
    return J.overlay(base, emp, ["key"], ["n"])


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1 HAVING count(*) >= 10")
def anti_having_backfill(t: Tables):
    known = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return t.orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 10")


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def semi_existing_targets(t: Tables):
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return e.join(t.part.where("p_size > 25"), F.col("dst") == F.col("p_partkey"), "left_semi").join(t.supplier.where("s_acctbal > 0"), F.col("src") == F.col("s_suppkey"), "left_semi")


@query("SELECT DISTINCT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey OR s_nationkey = n_regionkey")
def or_join_union(t: Tables):
    return J.either_key(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", t.nation, ["n_nationkey", "n_regionkey"], ["n_name"]).select("s_suppkey", "n_name").distinct()


@query("SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 3")
def division_all_tags(t: Tables):
    return J.division(t.orders, "o_custkey", "o_orderpriority", ["1-URGENT", "3-MEDIUM", "5-LOW"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_discount > 0.09)")
def exists_intersection(t: Tables):
    filled = t.orders.where("o_orderstatus = 'F'").select("o_custkey")
    deep = t.lineitem.where("l_discount > 0.09").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("k"))
    return t.customer.select("c_custkey").join(filled, F.col("c_custkey") == F.col("o_custkey"), "left_semi").join(deep, F.col("c_custkey") == F.col("k"), "left_semi")


@query("""WITH w AS (SELECT p_type AS tag, CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 3.0 WHEN p_type = 'SMALL' THEN 1.0 ELSE 2.0 END AS weight FROM part GROUP BY 1, 2)
SELECT l_suppkey, """ + r4("score") + " AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, l_suppkey) rank FROM (SELECT l_suppkey, sum(weight) + least(count(*) * 0.05, 3.0) AS score FROM (SELECT DISTINCT l_suppkey, p_type, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) JOIN w ON tag = p_type GROUP BY 1)) WHERE rank <= 20")
def weighted_tag_score(t: Tables):
    weight = F.when(F.col("p_type").isin("PROMO", "LARGE"), 3.0).when(F.col("p_type") == "SMALL", 1.0).otherwise(2.0)
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_type", "p_brand").distinct()
    s = d.groupBy("l_suppkey").agg((F.sum(weight) + N.capped(F.count("*"), 0.05, 3.0)).alias("score"))
    top = s.orderBy(F.desc("score"), "l_suppkey").limit(20)
    return J.top_n(top.withColumn("one", F.lit(1)), ["one"], [F.desc("score"), F.col("l_suppkey")], 20).select("l_suppkey", N.digits("score").alias("score"), "rank")


@query("SELECT p_type, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, " + r4("avg(l_discount)") + " AS avg_discount FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type")
def role_aggregate(t: Tables):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return d.groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), N.digits(F.avg("l_discount")).alias("avg_discount"))


@query("""WITH f AS (SELECT l_partkey AS k, 12.0 AS s, l_suppkey AS e FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 3 UNION ALL SELECT l_partkey, 8.0, l_suppkey FROM lineitem WHERE l_discount > 0.09 GROUP BY 1, 3 UNION ALL SELECT p_partkey, 20.0, NULL FROM part WHERE p_type = 'PROMO')
SELECT k AS key, sum(s)::DOUBLE AS score, count(DISTINCT e) AS n_enemies FROM f GROUP BY 1 ORDER BY n_enemies DESC, score DESC, key LIMIT 25""")
def team_counter_accumulate(t: Tables):
    fact = lambda d, s: d.select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("e")).distinct().withColumn("s", F.lit(s))
    facts = fact(t.lineitem.where("l_returnflag = 'R'"), 12.0).unionByName(fact(t.lineitem.where("l_discount > 0.09"), 8.0))
    facts = facts.unionByName(t.part.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("key"), F.lit(None).cast("bigint").alias("e"), F.lit(20.0).alias("s")))
    return facts.groupBy("key").agg(F.sum("s").alias("score"), F.count_distinct("e").alias("n_enemies")).orderBy(F.desc("n_enemies"), F.desc("score"), "key").limit(25)


@query("SELECT o_custkey, o_orderpriority AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) r FROM (SELECT o_custkey, o_orderpriority, count(*) n FROM orders GROUP BY 1, 2)) WHERE r = 1")
def dominant_category(t: Tables):
    c = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    best = c.groupBy("o_custkey").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("o_orderpriority").alias("mode"))).alias("b"))
    return best.select("o_custkey", F.col("b.mode").alias("mode"), (-F.col("b.m")).alias("n"))


@query("SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1")
def upsert_latest(t: Tables):
    return J.latest(t.events.select("event_type", "user_id", "ts", "event_id", "value"), ["event_type", "user_id"], ["ts", "event_id"]).select("event_type", "user_id", "event_id", "value")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def purge_missing(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


SETS = "a AS (SELECT DISTINCT source FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source FROM documents WHERE lang = 'de')"


@query(f"WITH {SETS} SELECT 'union' AS op, source FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', source FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', source FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def setops_union_intersect_except(t: Tables):
    a, b = (t.documents.where(F.col("lang") == x).select("source").distinct() for x in ("en", "de"))
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = [d.select(F.lit(k).alias("op"), "source") for k, d in ops.items()]
    return out[0].union(out[1]).union(out[2])


@query("SELECT p_type, p_brand, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) rank FROM (SELECT p_type, p_brand, count(*) n FROM part GROUP BY 1, 2)) WHERE rank <= 3")
def top_brands(t: Tables):
    c = t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return J.top_n(c, ["p_type"], [F.desc("n"), F.col("p_brand")], 3)


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey LIMIT 100")
def seeded_sample(t: Tables):
    return t.orders.orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("42"))), "o_orderkey").limit(100).select("o_orderkey")
