"""Queries on profiling, text functions and rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import arrays as A
from loomwright.functions import numeric as N
from loomwright.functions import text as X
from loomwright.operators import profile as P
from loomwright.operators import rules as R
from loomwright.operators.serving import normalised_messages
from loomwright.plans.base import CHAT, Registry, Tables, r4

query = Registry()
STATS = ", ".join(f"{r4(f'coalesce({e}, 0)')} AS {c}" for c, e in (("mean", "avg(v)"), ("std", "stddev_samp(v)"), ("min", "min(v)"), ("q25", "quantile_cont(v, 0.25)"), ("q50", "quantile_cont(v, 0.5)"), ("q75", "quantile_cont(v, 0.75)"), ("max", "max(v)")))
#: White space of \s in both engines' patterns: texts are squeezed by this set.
SQ = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"


@query(f"SELECT event_type, count(v) AS n, {STATS} FROM (SELECT event_type, value AS v FROM events) GROUP BY event_type")
def profile_numeric_stats(t: Tables):
    return P.describe(t.events, ["event_type"], "value")


@query(f"SELECT event_type AS value, count(*) AS n, {r4('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def profile_frequency(t: Tables):
    return P.frequency(t.events, "event_type")


@query("SELECT source AS value, count(*) AS n, " + r4("count(*) * 100.0 / sum(count(*)) OVER ()") + " AS pct FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, value LIMIT 10")
def profile_frequency_top(t: Tables):
    return P.frequency(t.documents, "source", 10)


@query("""WITH r AS (SELECT p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) a, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) b FROM part)
SELECT p_type, p_partkey, p_retailprice, a::INT AS rank, 'top' AS side FROM r WHERE a <= 5 UNION ALL SELECT p_type, p_partkey, p_retailprice, b::INT, 'bottom' FROM r WHERE b <= 5""")
def profile_outliers(t: Tables):
    return P.outliers(t.part, ["p_type"], "p_retailprice", "p_partkey", 5)


MISSING = ["text", "lang", "source", "entity_name"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (coalesce(trim({c}, ' '), '') = '') AS n_missing, {r4(f'''count(*) FILTER (coalesce(trim({c}, ' '), '') <> '') * 100.0 / count(*)''')} AS pct_present FROM documents" for c in MISSING))
def profile_completeness(t: Tables):
    return P.completeness(t.documents, dict.fromkeys(MISSING, "string"))


@query(f"SELECT source, count(*) AS n, count(*) FILTER (abs(n_chars - length(text)) <= 1) AS n_equal, {r4('count(*) FILTER (abs(n_chars - length(text)) <= 1)::DOUBLE / count(*)')} AS rate FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL GROUP BY source")
def profile_consistency(t: Tables):
    return P.consistency(t.documents, ["source"], F.col("n_chars"), F.length("text").cast("bigint"), 1)


@query(f"""WITH s AS (SELECT avg(CASE WHEN coalesce(trim(text, ' '), '') <> '' THEN 1.0 ELSE 0.0 END) a, avg(CASE WHEN lang IS NOT NULL THEN 1.0 ELSE 0.0 END) b, avg(CASE WHEN source IS NOT NULL THEN 1.0 ELSE 0.0 END) c, avg(CASE WHEN n_chars > 0 THEN 1.0 ELSE 0.0 END) d FROM documents)
SELECT {r4('a')} AS has_text, {r4('b')} AS has_lang, {r4('c')} AS has_source, {r4('d')} AS has_size, {r4('(a * 0.3 + b * 0.3 + c * 0.2 + d * 0.2) * 100.0')} AS score FROM s""")
def profile_readiness(t: Tables):
    present = lambda c: A.nullif_empty(c).isNotNull()
    return P.weighted_score(t.documents, {"has_text": (present("text"), 0.3), "has_lang": (F.col("lang").isNotNull(), 0.3), "has_source": (F.col("source").isNotNull(), 0.2), "has_size": (F.coalesce(F.col("n_chars") > 0, F.lit(False)), 0.2)})


@query("""SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS returned, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09) AS discounted, count(*) AS n
FROM part GROUP BY 1, 2""")
def profile_hierarchy(t: Tables):
    use = t.lineitem.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_discount") > 0.09).alias("d"))
    j = t.part.join(use, F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.groupBy(F.coalesce("r", F.lit(False)).alias("returned"), F.coalesce("d", F.lit(False)).alias("discounted")).agg(F.count("*").alias("n"))


@query(f"SELECT lang, count(v) AS n, {STATS} FROM (SELECT lang, CASE WHEN s = '' OR s IS NULL THEN 0 ELSE len(string_split(s, ' ')) END::DOUBLE AS v FROM (SELECT lang, {SQ.format('text')} AS s FROM documents)) GROUP BY lang")
def profile_wordcount(t: Tables):
    return P.describe(t.documents.select("lang", X.word_count("text").cast("double").alias("v")), ["lang"], "v")


KEYWORDS = ["stun", "slow", "shield", "dragon", "herald", "patch"]


@query("WITH f AS (SELECT " + " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{w}') THEN 1 ELSE 0 END" for w in KEYWORDS) + " AS n_keywords FROM documents) SELECT n_keywords, count(*) AS n_docs FROM f GROUP BY 1")
def profile_keyword_coverage(t: Tables):
    return t.documents.groupBy(F.size(R.contains_flags("text", KEYWORDS)).alias("n_keywords")).agg(F.count("*").alias("n_docs"))


@query("SELECT p_type, count(*) FILTER (p_size <= 15) AS small, count(*) FILTER (p_size BETWEEN 16 AND 35) AS medium, count(*) FILTER (p_size > 35) AS large FROM part GROUP BY p_type")
def profile_tree_pivot(t: Tables):
    size = R.first_match([("small", F.col("p_size") <= 15), ("medium", F.col("p_size") <= 35), ("large", F.col("p_size") > 35)])
    return t.part.withColumn("bucket", size).groupBy("p_type").pivot("bucket", ["small", "medium", "large"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 50 THEN 11 ELSE floor(value / 5) + 1 END::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def profile_histogram(t: Tables):
    return P.histogram(t.events, "value", 0.0, 50.0, 10)


RE2 = [(k, p.replace("(?i)", "")) for k, p in R.CONTROL]


@query("SELECT doc_id, " + "concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{k}' END" for k, p in sorted(RE2)) + ") AS tags, " + " + ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{dict(RE2)[k]}') THEN 1 ELSE 0 END" for k in R.HARD) + " AS n_hard FROM documents")
def rule_tagging(t: Tables):
    tags = R.tag("text", R.CONTROL)
    return t.documents.select("doc_id", F.array_join(tags, "|").alias("tags"), F.size(F.array_intersect(tags, F.array(*map(F.lit, R.HARD)))).alias("n_hard"))


@query()
def rule_tagging_lookaround(t: Tables):
    rules = [("slow_not_slower", r"\bslow(?!er)"), ("stun_not_no", r"(?<!no )\bstun"), ("shield_first", r"^(?:(?!fear).)*shield")]
    return t.documents.select("doc_id", F.array_join(R.tag("text", rules), "|").alias("tags"))


@query("""WITH d AS (SELECT doc_id, lower(string_split(text, 'Fun fact')[1]) AS s FROM documents)
SELECT doc_id, concat_ws('|', CASE WHEN regexp_matches(s, 'dash') AND NOT regexp_matches(s, 'cancels the dash') THEN 'dash' END, CASE WHEN regexp_matches(s, 'shield') THEN 'shield' END, CASE WHEN regexp_matches(s, 'true damage') AND NOT regexp_matches(s, 'magic damage') THEN 'true_damage' END) AS tags FROM d""")
def mechanic_tagging(t: Tables):
    rules = [("dash", "dash", "cancels the dash"), ("shield", "shield", None), ("true_damage", "true damage", "magic damage")]
    return t.documents.select("doc_id", F.array_join(R.tag_except("text", rules, "fun fact"), "|").alias("tags"))


@query("SELECT doc_id, md5(" + SQ.format("regexp_replace(text, '<[^>]+>', ' ', 'g')") + ") AS clean_md5 FROM documents WHERE contains(text, '<')")
def html_clean(t: Tables):
    return t.documents.where(F.contains("text", F.lit("<"))).select("doc_id", F.md5(X.clean_html("text")).alias("clean_md5"))


@query()
def html_paragraphs(t: Tables):
    return t.documents.where(F.contains("text", F.lit("<"))).select("doc_id", X.clean_html_paragraphs(X.unescape("text")).alias("clean"))


@query("""WITH b AS (SELECT event_id, unnest(regexp_extract_all('<script>{"body": ' || props || '}</script><p>x</p><script>{"body": {"k": -1}}</script>', '<script[^>]*>([^<]*)</script>', 1)) AS s FROM events)
SELECT event_id, json_extract_string(s, '$.body.k')::BIGINT AS k FROM b WHERE json_extract_string(s, '$.body.k')::BIGINT >= 0""")
def html_script_json(t: Tables):
    page = F.concat(F.lit('<script>{"body": '), "props", F.lit('}</script><p>x</p><script>{"body": {"k": -1}}</script>'))
    bodies = t.events.select("event_id", F.explode(X.script_bodies(page)).alias("s"))
    k = F.get_json_object("s", "$.body.k").try_cast("bigint")
    return bodies.select("event_id", k.alias("k")).where("k >= 0")


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\d+) of (\d+) ranked', 1)) AS a, unnest(regexp_extract_all(text, '(\d+) of (\d+) ranked', 2)) AS b FROM documents)
SELECT doc_id, a::BIGINT AS wins, b::BIGINT AS games FROM m""")
def regex_tuple_parse(t: Tables):
    zipped = X.tuples_in_text("text", {"wins": r"(\d+) of \d+ ranked", "games": r"\d+ of (\d+) ranked"})
    rows = t.documents.select("doc_id", F.explode(zipped).alias("m"))
    return rows.select("doc_id", F.col("m.wins").cast("bigint").alias("wins"), F.col("m.games").cast("bigint").alias("games"))


@query("SELECT doc_id, ceil(strlen(coalesce(text, '')) / 3.0)::BIGINT AS tokens, CASE WHEN ceil(strlen(coalesce(text, '')) / 3.0) <= 256 THEN 256 WHEN ceil(strlen(coalesce(text, '')) / 3.0) <= 512 THEN 512 ELSE 768 END AS budget FROM documents")
def token_estimate(t: Tables):
    n = X.token_estimate("text")
    return t.documents.select("doc_id", n.alias("tokens"), F.when(n <= 256, 256).when(n <= 512, 512).otherwise(768).alias("budget"))


@query("SELECT p_partkey, level, " + r4("CASE WHEN level > 1 AND p_size > 0 THEN p_retailprice + p_size * (level - 1) * (0.7025 + 0.0175 * (level - 1)) ELSE p_retailprice END", 2) + " AS value FROM part, (SELECT unnest([1, 2, 9, 18]) AS level)")
def level_growth(t: Tables):
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("s"), "p_retailprice", F.explode(F.array(*map(F.lit, (1, 2, 9, 18)))).alias("level"))
    return rows.select("p_partkey", "level", N.digits(N.growth("p_retailprice", "s", "level"), 2).alias("value"))


@query("SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[ ''._:,&/-]', '', 'g') AS norm, lower(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1:1]), '')) AS acronym, len(string_split(trim(p_name), ' '))::INT AS n_words FROM part")
def name_keys(t: Tables):
    return t.part.select("p_partkey", X.normalize_key("p_name").alias("norm"), X.acronym("p_name").alias("acronym"), X.word_count("p_name").alias("n_words"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN json_extract_string(props, '$.k')::BIGINT >= 50 THEN 'high' ELSE 'low' END AS side FROM events")
def json_props(t: Tables):
    k = F.from_json("props", "k bigint")["k"]
    return t.events.select("event_id", k.alias("k"), F.when(k >= 50, "high").otherwise("low").alias("side"))


@query("SELECT id, regexp_replace(regexp_replace(lower(content), '^which items', 'what items', 'g'), 'buy first on', 'buy for', 'g') AS content FROM lol_chat_messages WHERE content IS NOT NULL")
def typo_rewrite(t: Tables):
    return t.lol_chat_messages.where("content is not null").select("id", X.rewrite(F.lower("content"), [(r"^which items", "what items"), ("buy first on", "buy for")]).alias("content"))


@query("""SELECT l_partkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS n_returned FROM lineitem GROUP BY l_partkey HAVING count(*) >= 35""")
def frequent_parts(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned")).where("n >= 35")


@query(f"WITH {CHAT}, r AS (SELECT skey, id, row_number() OVER (PARTITION BY skey ORDER BY created_at DESC, id DESC) AS k FROM m WHERE created_at IS NOT NULL) SELECT skey AS session_id, k::INT AS back, id FROM r WHERE k <= 4")
def recent_history(t: Tables):
    rows = normalised_messages(t.lol_chat_messages).where("created_at is not null")
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("back", F.row_number().over(w)).where("back <= 4").select("session_id", "back", "id")
