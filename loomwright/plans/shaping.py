"""Queries that shape records, and on history and token budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import numeric as N
from loomwright.functions import text as X
from loomwright.operators import serving as S
from loomwright.operators import shaping as H
from loomwright.plans.base import CHAT, Registry, Tables, r4

query = Registry()


@query("SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'nation', n_nationkey, upper(n_name), NULL, NULL FROM nation")
def source_flatten(t: Tables):
    return H.flatten_sources({
        "customer": (t.customer, {"id": "c_custkey", "name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}),
        "supplier": (t.supplier, {"id": "s_suppkey", "name": "s_name", "balance": "s_acctbal"}), "nation": (t.nation, {"id": "n_nationkey", "name": F.upper("n_name")}),
    })


@query("SELECT DISTINCT record_id, roles[1] AS main, roles[2] AS side FROM champions WHERE roles IS NOT NULL")
def ordinal_keys(t: Tables):
    m = H.keyed(F.col("roles"), ["main", "side"])
    return t.champions.where("roles is not null").select("record_id", F.try_element_at(m, F.lit("main")).alias("main"), F.try_element_at(m, F.lit("side")).alias("side")).distinct()


@query(r"""SELECT doc_id, concat_ws('|', CASE WHEN trim(lang, ' ') <> '' THEN 'lang' END, CASE WHEN trim(source, ' ') <> '' THEN 'source' END, CASE WHEN trim(entity_name, ' ') <> '' THEN 'entity' END) AS props FROM documents""")
def filled_props(t: Tables):
    m = H.filled({"lang": F.col("lang"), "source": F.col("source"), "entity": F.col("entity_name")})
    return t.documents.select("doc_id", F.array_join(F.map_keys(m), "|").alias("props"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT starts_with(c_name, 'Customer#00000000')")
def prefix_skipped(t: Tables):
    return t.customer.where(~F.startswith("c_name", F.lit("Customer#00000000"))).select("c_custkey", "c_name")


RANKS = "r AS (SELECT record_id, k, v[1].cooldown.modifiers[1].values AS vs FROM (SELECT DISTINCT record_id, unnest(map_keys(abilities)) AS k, unnest(map_values(abilities)) AS v FROM champions))"


@query(f"WITH {RANKS} SELECT record_id, k AS letter, CASE WHEN len(vs) >= 3 THEN CAST(vs[3] AS VARCHAR) ELSE CAST(len(vs) AS VARCHAR) || ' values' END AS value FROM r WHERE vs IS NOT NULL")
def value_at_rank(t: Tables):
    a = t.champions.select("record_id", F.explode("abilities").alias("letter", "v")).select("record_id", "letter", F.get(F.get(F.col("v"), F.lit(0))["cooldown"]["modifiers"], F.lit(0))["values"].alias("vs")).distinct()
    got = H.at_rank(F.col("vs"), F.lit(3))
    return a.where("vs is not null").select("record_id", "letter", F.when(F.size("vs") >= 3, F.get(got, F.lit(0)).cast("string")).otherwise(F.concat(F.size(got).cast("string"), F.lit(" values"))).alias("value"))


@query("""WITH s AS (SELECT DISTINCT record_id, stats FROM champions WHERE stats IS NOT NULL)
SELECT record_id, len(list_filter(map_values(stats), lambda x: x.flat IS NOT NULL)) AS n_base, len(list_filter(map_values(stats), lambda x: x.perLevel IS NOT NULL)) AS n_growth FROM s""")
def base_growth_split(t: Tables):
    p = H.base_and_growth(F.col("stats"))
    return t.champions.where("stats is not null").dropDuplicates(["record_id"]).select("record_id", F.size(p["base"]).cast("bigint").alias("n_base"), F.size(p["growth"]).cast("bigint").alias("n_growth"))


@query("""WITH a AS (SELECT DISTINCT p_type AS asked FROM part UNION SELECT unnest(['brushed', 'the ECONOMY ANODIZED STEEL case', 'zz', 'nothing here'])), n AS (SELECT DISTINCT p_type AS name FROM part)
SELECT asked, (SELECT name FROM n WHERE contains(lower(trim(asked)), lower(name)) OR contains(lower(name), lower(trim(asked))) ORDER BY lower(name) <> lower(trim(asked)), -length(name), name LIMIT 1) AS name FROM a""")
def containment_lookup(t: Tables):
    more = t.spark.createDataFrame([("brushed",), ("the ECONOMY ANODIZED STEEL case",), ("zz",), ("nothing here",)], "asked string")
    return H.contained(t.part.select(F.col("p_type").alias("asked")).union(more), t.part.select(F.col("p_type").alias("name")))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS p, CAST(l_suppkey AS VARCHAR) AS i, coalesce(s_name, CAST(l_suppkey AS VARCHAR)) AS name FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 12) ON s_suppkey = l_suppkey)
SELECT k AS l_orderkey, string_agg(name, '>' ORDER BY p, i) AS names FROM l GROUP BY 1""")
def recipe_names(t: Tables):
    ids = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey").cast("string").alias("id")))).alias("a")).select("l_orderkey", F.transform("a", lambda x: x["id"]).alias("ids"))
    return H.resolve_ids(ids, "l_orderkey", "ids", t.supplier.where("s_nationkey < 12").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).select("l_orderkey", F.array_join("names", ">").alias("names"))


@query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rank FROM c) WHERE rank <= 2")
def two_most_common(t: Tables):
    return H.most_common(t.customer, "c_nationkey", "c_mktsegment", 2)


@query("""WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rank, lead(n) OVER w AS nx FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus))
SELECT o_custkey, CASE WHEN nx = n THEN 'Mixed' ELSE o_orderstatus END AS o_orderstatus, n, rank FROM r WHERE rank = 1""")
def dominant_or_mixed(t: Tables):
    return H.most_common(t.orders, "o_custkey", "o_orderstatus", 1, "Mixed")


@query("WITH d AS (SELECT DISTINCT source, entity_name FROM documents WHERE entity_name IS NOT NULL), s AS (SELECT source, string_agg(entity_name, '|' ORDER BY entity_name) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY entity_name) r FROM d) WHERE r <= 10 GROUP BY 1) SELECT c.source, n, samples FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) c LEFT JOIN s USING (source)")
def filter_summary(t: Tables):
    return H.with_samples(t.documents.where("source is not null"), "source", "entity_name").withColumn("samples", F.array_join("samples", "|"))


@query("WITH c AS (SELECT l_orderkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linestatus, n FROM (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS a FROM c) WHERE n >= greatest(2, 0.6 * a)")
def team_profile(t: Tables):
    return H.large_share(t.lineitem, "l_orderkey", "l_linestatus")


@query("SELECT l_orderkey, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS states, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags, count(*) AS n FROM lineitem GROUP BY 1")
def team_sets(t: Tables):
    sets = [F.array_join(F.array_sort(F.collect_set(c)), "|").alias(a) for c, a in (("l_linestatus", "states"), ("l_returnflag", "flags"))]
    return t.lineitem.groupBy("l_orderkey").agg(*sets, F.count("*").alias("n"))


@query("SELECT DISTINCT lower(trim(x, ' ')) AS role FROM (SELECT unnest(roles) AS x FROM champions) WHERE trim(x, ' ') <> ''")
def taxonomy(t: Tables):
    return t.champions.select(F.explode("roles").alias("x")).select(F.lower(F.trim("x")).alias("role")).where("role != ''").distinct()


@query(f"SELECT source, count(*) AS n, count(title) AS n_title, count(roles) AS n_roles, {r4('count(stats) * 1.0 / count(*)')} AS share_stats FROM champions GROUP BY 1")
def source_coverage(t: Tables):
    return t.champions.groupBy("source").agg(F.count("*").alias("n"), F.count("title").alias("n_title"), F.count("roles").alias("n_roles"), N.digits(F.count("stats") / F.count("*")).alias("share_stats"))


@query("SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_custkey) AS rank FROM customer) WHERE rank <= 6")
def lane_first(t: Tables):
    return H.preferred_first(t.customer, "c_nationkey", F.col("c_mktsegment") == "BUILDING", [F.col("c_custkey")], 6).select("c_nationkey", "c_custkey", "rank")


@query("SELECT x, row_number() OVER (ORDER BY TRY_CAST(x AS BIGINT) IS NULL, TRY_CAST(x AS BIGINT), x) AS rank FROM (SELECT CAST(n_nationkey AS VARCHAR) AS x FROM nation UNION ALL SELECT n_name FROM nation)")
def numeric_id_sort(t: Tables):
    from pyspark.sql.window import Window

    ids = t.nation.select(F.col("n_nationkey").cast("string").alias("x")).union(t.nation.select("n_name"))
    return ids.withColumn("rank", F.row_number().over(Window.orderBy(*H.numeric_order("x"))))  # a table of fixed size


@query(f"WITH {CHAT} SELECT skey AS session_id, count(*) AS n_messages, max(created_at) AS last_at FROM m GROUP BY 1 HAVING count(*) >= 4")
def session_summary(t: Tables):
    """Messages of each session, however it is spelled; re-delivered rows count once."""
    m = S.normalised_messages(t.lol_chat_messages)
    return m.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("created_at").alias("last_at")).where("n_messages >= 4")


@query(f"WITH {CHAT} SELECT DISTINCT lower(session_id) AS session_id FROM lol_chat_sessions WHERE lower(session_id) NOT IN (SELECT skey FROM m)")
def empty_session_anti(t: Tables):
    return S.without_messages(t.lol_chat_sessions.select(S.session_key("session_id").alias("session_id")).distinct(), S.normalised_messages(t.lol_chat_messages))


@query(f"WITH {CHAT} SELECT role, count(*) AS n FROM m GROUP BY 1")
def speakers(t: Tables):
    return S.normalised_messages(t.lol_chat_messages).groupBy("role").agg(F.count("*").alias("n"))


#: SQL of the longest start of a text within so many bytes.
CUT = "(SELECT coalesce(max(i), 0) FROM range(1, length({0}) + 1) g(i) WHERE strlen(left({0}, CAST(i AS INT))) <= {1})"


@query(f"""WITH {CHAT}, l AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY created_at DESC, id DESC) AS n, count(*) OVER (PARTITION BY skey) AS c FROM m WHERE created_at IS NOT NULL),
s AS (SELECT *, trim(content, ' ') AS txt, greatest(1, 256 // (least(4, c) + 1)) AS b FROM l WHERE n <= 4),
p AS (SELECT *, CASE WHEN b > 1 THEN (b - 1) * 3 ELSE b * 3 END AS room FROM s WHERE coalesce(txt, '') <> ''),
q AS (SELECT skey, n, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN ceil(strlen(txt) / 3.0) <= b THEN txt ELSE rtrim(left(txt, CAST({CUT.format('txt', 'room')} AS INT)), ' ') || '...' END AS line FROM p)
SELECT skey AS session_id, string_agg(line, chr(10) ORDER BY n DESC) AS history FROM q GROUP BY 1""")
def history_text(t: Tables):
    m = S.normalised_messages(t.lol_chat_messages).where("created_at is not null")
    speaker = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    return S.format_history(m.withColumn("speaker", speaker), "session_id", "speaker", "content", [F.desc("created_at"), F.desc("id")])


@query(f"WITH d AS (SELECT doc_id, text, 100 - 10 AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN ceil(strlen(text) / 3.0) <= 90 THEN text ELSE rtrim(left(text, CAST({CUT.format('text', '264')} AS INT)), ' ') || ' [cut]' END AS text FROM d")
def context_fitted(t: Tables):
    """Contexts cut to what the window leaves; many are in wide characters."""
    return t.documents.where("text is not null").select("doc_id", S.fit_context("text", 1000, 604, F.lit("x" * 150), mark=" [cut]").alias("text"))


@query("SELECT item_id, split, strftime(make_timestamp(item_id * 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM eval_items")
def utc_stamp(t: Tables):
    return t.eval_items.select("item_id", "split", X.utc_iso(F.timestamp_micros(F.col("item_id") * 1_000_000_000)).alias("at"))


@query(f"""WITH x AS (SELECT doc_id, CASE WHEN ceil(strlen(text) / 3.0) <= 100 THEN text ELSE rtrim(left(text, CAST({CUT.format('text', '297')} AS INT)), ' ') || '...' END AS text FROM documents)
SELECT doc_id, text, coalesce(CAST(ceil(strlen(text) / 3.0) AS BIGINT), 0) AS tokens FROM x""")
def truncate_budget(t: Tables):
    return t.documents.select("doc_id", X.truncate_tokens("text", 100).alias("text")).withColumn("tokens", X.token_estimate("text"))
