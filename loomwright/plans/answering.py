"""Queries on chunks, intents, history, evaluation and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import numeric as N
from loomwright.functions.text import squeeze
from loomwright.operators import evaluation as E
from loomwright.operators import serving as S
from loomwright.operators import trainset as M
from loomwright.operators.retrieval import topk
from loomwright.plans.base import CHAT, Registry, Tables, r4
from loomwright.plans.searching import ALL, QV, RANK, _vectors

query = Registry()
ONE = "c AS (SELECT record_id, any_value(name) AS name, any_value(title) AS title, any_value(resource) AS resource, any_value(attack_type) AS attack_type, any_value(source) AS source FROM champions GROUP BY record_id)"
SQUEEZE = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"


def _by_score():
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "id")


@query(f"""WITH {ONE}, u AS (SELECT record_id, name, 'overview' AS k, {SQUEEZE.format("concat_ws(' ', name, title, attack_type)")} AS t FROM c UNION ALL SELECT record_id, name, 'resource', {SQUEEZE.format("concat_ws(' ', name, 'uses', resource)")} FROM c WHERE resource IS NOT NULL)
SELECT record_id || ':' || k AS chunk_id, name AS entity_name, k AS chunk_type, t AS text FROM u WHERE t <> ''""")
def chunk_documents(t: Tables):
    c = t.champions.select("record_id", "name", "title", "resource", "attack_type").dropDuplicates(["record_id"])
    return S.chunk(c, "record_id", "name", {"overview": (F.concat_ws(" ", "name", "title", "attack_type"), None), "resource": (F.concat_ws(" ", "name", F.lit("uses"), "resource"), F.col("resource").isNotNull())})


@query("SELECT chunk_type, entity_type, count(*) AS n FROM document_chunks GROUP BY CUBE (chunk_type, entity_type)")
def chunk_stats_cube(t: Tables):
    return t.document_chunks.cube("chunk_type", "entity_type").agg(F.count("*").alias("n"))


CASES = " ".join(f"WHEN regexp_matches(lower(content), '{p}') THEN '{k}'" for k, p in S.INTENTS)
USERS = f"{CHAT}, u AS (SELECT id, content FROM m WHERE role = 'user' AND content IS NOT NULL)"


def _questions(t: Tables):
    """Messages of users, however their role is spelled."""
    return S.normalised_messages(t.lol_chat_messages).where("role = 'user' and content is not null").select("id", "content")


@query(f"WITH {USERS} SELECT id, CASE {CASES} ELSE 'UNKNOWN' END AS intent FROM u")
def intent_rules(t: Tables):
    u = _questions(t)
    return u.select("id", S.intent("content").alias("intent"))


@query(f"""WITH {USERS}, i AS (SELECT id, content, CASE {CASES} ELSE 'UNKNOWN' END AS k, regexp_extract(content, '[A-Z][a-z]+(es|us|is|os|as|en|in|an|on|un)', 0) AS e FROM u)
SELECT id, CASE WHEN e <> '' THEN CASE k WHEN 'COUNTER' THEN e || ' counters weak against' WHEN 'BUILD' THEN e || ' build core items' WHEN 'LORE' THEN e || ' lore story region' WHEN 'SKILL_INFO' THEN e || ' ability cooldown' WHEN 'SYNERGY' THEN e || ' synergy duo partners' ELSE e || ' ' || lower(k) END ELSE content END AS search, CASE k WHEN 'ITEM' THEN 256 WHEN 'LORE' THEN 512 WHEN 'COMPARISON' THEN 768 WHEN 'COUNTER' THEN 768 ELSE 512 END AS budget FROM i""")
def query_rewrite(t: Tables):
    u = _questions(t)
    i = u.withColumns({"k": S.intent("content"), "e": F.regexp_extract("content", "[A-Z][a-z]+(es|us|is|os|as|en|in|an|on|un)", 0)})
    return i.select("id", S.rewrite_query(F.col("k"), F.col("e"), F.col("content")).alias("search"), S.answer_budget(F.col("k")).alias("budget"))


@query(f"WITH {USERS}, i AS (SELECT id, CASE {CASES} ELSE 'UNKNOWN' END AS k FROM u) SELECT id, CASE k WHEN 'LORE' THEN 'story' WHEN 'BUILD' THEN 'shop' ELSE 'search' END AS handler FROM i")
def dispatch_by_intent(t: Tables):
    u = _questions(t).withColumn("k", S.intent("content"))
    to = lambda name: lambda d: d.select("id", F.lit(name).alias("handler"))
    return S.dispatch(u, "k", {"LORE": to("story"), "BUILD": to("shop")}, to("search"))


GUESS = "CASE WHEN o_totalprice < 100000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END"
PRF = f"""p AS (SELECT o_orderstatus AS g, {GUESS} AS h FROM orders), l AS (SELECT g AS label FROM p UNION SELECT h FROM p),
m AS (SELECT label, (SELECT count(*) FROM p WHERE g = label AND h = label) AS tp, (SELECT count(*) FROM p WHERE g <> label AND h = label) AS fp, (SELECT count(*) FROM p WHERE g = label AND h <> label) AS fn FROM l),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS re FROM m),
f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM r)"""


def _guessed(t: Tables):
    return t.orders.withColumn("guess", F.expr(GUESS))


@query(f"WITH {PRF} SELECT label, tp, fp, fn, {r4('pr')} AS precision, {r4('re')} AS recall, {r4('f1')} AS f1 FROM f")
def eval_intent_prf(t: Tables):
    m = E.class_metrics(_guessed(t), "o_orderstatus", "guess")
    return m.select("label", "tp", "fp", "fn", *[N.digits(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {PRF} SELECT {r4('avg(f1)')} AS macro_f1, {r4('sum(tp)::DOUBLE / sum(tp + fn)')} AS accuracy FROM f WHERE tp + fn > 0")
def eval_macro(t: Tables):
    return E.macro_f1(E.class_metrics(_guessed(t), "o_orderstatus", "guess")).select(N.digits("macro_f1").alias("macro_f1"), N.digits("accuracy").alias("accuracy"))


@query(f"SELECT o_orderstatus AS gold, {GUESS} AS predicted, count(*) AS n FROM orders WHERE o_orderstatus <> {GUESS} GROUP BY 1, 2 ORDER BY n DESC, gold, predicted LIMIT 15")
def eval_confusion(t: Tables):
    return E.confusions(_guessed(t), "o_orderstatus", "guess")


@query(f"""WITH {QV}, {ALL}, t AS (SELECT *, {RANK} AS rank FROM s WHERE id <> query_id), r AS (SELECT query_id, rank, (label = ql)::INT AS rel FROM t WHERE rank <= 5), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best FROM r)
SELECT query_id, max(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS hit1, max(CASE WHEN rank <= 3 THEN rel ELSE 0 END) AS hit3, max(rel) AS hitk, {r4('sum(rel)::DOUBLE / count(*)')} AS precision, {r4('coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0)')} AS rr,
{r4('CASE WHEN sum(rel) = 0 THEN 0 ELSE sum(rel / log2(rank + 1.0)) / sum(rel / log2(best + 1.0)) END')} AS ndcg FROM b GROUP BY 1""")
def eval_retrieval(t: Tables):
    c, q = _vectors(t)
    gold = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    top = topk(c, q, 6).where("id != query_id").join(c.select("id", "label"), "id").join(gold, "query_id")
    ranked = top.withColumn("rank", F.row_number().over(_by_score())).withColumn("relevant", F.col("label") == F.col("ql"))
    m = E.retrieval_metrics(ranked, 5)
    return m.select("query_id", "hit1", "hit3", "hitk", *[N.digits(x).alias(x) for x in ("precision", "rr", "ndcg")])


@query(f"SELECT count(value) AS n, {r4('avg(value - 20)')} AS mean, {r4('stddev_pop(value - 20)')} AS std, {r4('avg(CASE WHEN value - 20 < 0 THEN 1.0 ELSE 0.0 END)')} AS negative, {r4('quantile_cont(value - 20, 0.95)')} AS p95 FROM events")
def eval_score_distribution(t: Tables):
    return E.score_distribution(t.events.select((F.col("value") - 20).alias("x")), "x")


@query(f"WITH {QV}, {ALL}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE id <> query_id) SELECT query_id, min(rank)::INT AS first_rank, {r4('1.0 / min(rank)')} AS rr FROM t WHERE label = ql AND rank <= 1000 GROUP BY 1")
def eval_triplet_pool(t: Tables):
    c, q = _vectors(t)
    gold = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    top = topk(c, q, 1001).where("id != query_id").withColumn("rank", F.row_number().over(_by_score())).where("rank <= 1000")
    return top.join(c.select("id", "label"), "id").join(gold, "query_id").where("label = ql").groupBy("query_id").agg(F.min("rank").alias("first_rank")).withColumn("rr", N.digits(1.0 / F.col("first_rank")))


MD5 = "('0x' || md5({})[1:8])::BIGINT % 10"


@query("SELECT doc_id, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, " + MD5.format("doc_id::VARCHAR") + " AS b FROM documents)")
def split_hash(t: Tables):
    return t.documents.select("doc_id", M.split_of(F.col("doc_id").cast("string")).alias("split"))


@query("SELECT doc_id, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, " + MD5.format("lower(" + SQUEEZE.format("coalesce(text, '')") + ")") + " AS b FROM documents)")
def split_grouped(t: Tables):
    return t.documents.select("doc_id", M.split_of(F.lower(squeeze(F.coalesce("text", F.lit(""))))).alias("split"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower({SQUEEZE.format('text')})")
def dedupe_first(t: Tables):
    return M.first_of(t.documents.select("doc_id", "text"), F.lower(squeeze("text")), "doc_id").select("doc_id")


@query("WITH d AS (SELECT DISTINCT split AS s, lower(trim(query, ' ')) AS t FROM training_triplets WHERE trim(query, ' ') <> '') SELECT x.s AS a, y.s AS b, count(*) AS n FROM d x JOIN d y ON x.t = y.t AND x.s < y.s GROUP BY 1, 2")
def leakage_audit(t: Tables):
    return M.leakage(t.training_triplets, "split", F.col("query"))


@query("WITH d AS (SELECT DISTINCT split AS s, trim(positive, ' ') AS t FROM training_triplets WHERE trim(positive, ' ') <> '') SELECT x.s AS a, y.s AS b, count(*) AS n FROM d x JOIN d y ON x.t = y.t AND x.s < y.s GROUP BY 1, 2")
def leakage_audit_passages(t: Tables):
    """The other half of leakage_audit; as in the reference, passages that differ in case are different."""
    return M.leakage(t.training_triplets, "split", F.col("positive"), fold=False)


@query("WITH h AS (SELECT lower(trim(query, ' ')) q, lower(trim(positive, ' ')) p FROM training_triplets WHERE split <> 'train') SELECT DISTINCT triplet_id FROM training_triplets WHERE split = 'train' AND lower(trim(query, ' ')) NOT IN (SELECT q FROM h WHERE q IS NOT NULL) AND lower(trim(positive, ' ')) NOT IN (SELECT p FROM h WHERE p IS NOT NULL)")
def leakage_free_train(t: Tables):
    tr, held = t.training_triplets.where("split = 'train'"), t.training_triplets.where("split != 'train'")
    return M.clean_of(tr, held, F.col("query"), F.col("positive")).select("triplet_id").distinct()


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS g, p_type, p_size, md5(p_partkey::VARCHAR || '|42') AS h FROM part), x AS (SELECT a.id AS anchor_id, b.id AS negative_id, CASE WHEN a.p_type = b.p_type AND a.p_size = b.p_size THEN 1 ELSE 2 END AS tier, b.h FROM p a JOIN p b ON a.p_type = b.p_type AND a.g <> b.g)
SELECT anchor_id, negative_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY tier, h, negative_id) r FROM x) WHERE r = 1""")
def hard_negatives(t: Tables):
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("group"), "p_type", "p_size")
    return M.hard_negatives(p, p, [["p_type", "p_size"], ["p_type"]])


TEMPLATES = ["What is {}?", "Tell me about {}", "Who uses {}?", "Where do I find {}?", "Is {} good?"]


@query("SELECT p_partkey, template, replace(pattern, '{}', p_name) AS query FROM (SELECT p_partkey, p_name, (i - 1)::INT AS template, l[i] AS pattern, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(p_partkey || '|' || (i - 1) || '|42'), i) r FROM part, (SELECT [" + ", ".join(f"'{x}'" for x in TEMPLATES) + "] AS l), range(1, 6) t(i)) WHERE r <= 2")
def triplet_templates(t: Tables):
    return M.templated(t.part, "p_partkey", TEMPLATES, "p_name", 2)


@query("SELECT intent, count(*) AS n, sum(CASE WHEN len(relevant_chunks) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_labelled FROM eval_items GROUP BY intent")
def gold_counts(t: Tables):
    return t.eval_items.groupBy("intent").agg(F.count("*").alias("n"), F.count_if(F.size("relevant_chunks") > 0).alias("n_labelled"))


@query("SELECT split, c AS chunk_key, count(*) AS n FROM (SELECT split, unnest(relevant_chunks) AS c FROM eval_items) GROUP BY 1, 2")
def gold_chunks(t: Tables):
    return t.eval_items.select("split", F.explode("relevant_chunks").alias("chunk_key")).groupBy("split", "chunk_key").agg(F.count("*").alias("n"))
