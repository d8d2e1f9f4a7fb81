"""Queries on nested champion records: maps, lists, filters, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import maps as M
from loomwright.functions.arrays import first_n
from loomwright.operators import entities as N
from loomwright.plans.base import Registry, Tables

query = Registry()
ONE = "c AS (SELECT record_id, any_value(source) AS source, any_value(name) AS name, any_value(title) AS title, any_value(stats) AS stats, any_value(abilities) AS abilities, any_value(roles) AS roles, any_value(positions) AS positions, any_value(resource) AS resource, any_value(attack_type) AS attack_type FROM champions GROUP BY record_id)"


def _one(t: Tables):
    return t.champions.dropDuplicates(["record_id"])


@query(f"WITH {ONE}, e AS (SELECT record_id, unnest(map_entries(stats)) AS x FROM c) SELECT record_id, CASE x.key WHEN 'health' THEN 'hp' WHEN 'mana' THEN 'mp' ELSE x.key END AS stat, x.value.flat AS flat FROM e WHERE x.value.flat IS NOT NULL AND NOT isnan(x.value.flat) AND x.value.flat NOT IN (0, 1)")
def stat_values(t: Tables):
    flat = F.transform_values("stats", lambda _, v: F.when(~F.isnan(v["flat"]), v["flat"]))
    m = M.rename_keys(M.drop_values(flat, 0.0, 1.0), {"health": "hp", "mana": "mp"})
    return _one(t).select("record_id", F.explode(m).alias("stat", "flat"))


@query(f"WITH {ONE}, e AS (SELECT record_id, unnest(map_entries(stats)) AS x FROM c) SELECT record_id, count(*) AS n FROM e WHERE starts_with(x.key, 'attack') GROUP BY 1")
def stat_prefix(t: Tables):
    return _one(t).select("record_id", F.size(M.with_prefix("stats", "attack")).alias("n")).where("n > 0").withColumn("n", F.col("n").cast("bigint"))


@query(f"""WITH {ONE}, a AS (SELECT record_id, unnest(map_entries(abilities)) AS x FROM c), b AS (SELECT record_id, x.key AS letter, unnest(range(1, len(x.value) + 1)) - 1 AS n, unnest(x.value) AS v FROM a)
SELECT record_id, letter, n::INT AS n, v.cooldown.modifiers[1].values[1] AS first_cooldown FROM b WHERE v.cooldown.modifiers[1].values[1] IS NOT NULL""")
def ability_cooldowns(t: Tables):
    a = _one(t).select("record_id", F.explode("abilities").alias("letter", "l")).select("record_id", "letter", F.posexplode("l").alias("n", "v"))
    return a.select("record_id", "letter", "n", F.get(M.first_values("v.cooldown.modifiers"), F.lit(0)).alias("first_cooldown")).where("first_cooldown is not null")


@query(f"WITH {ONE} SELECT record_id FROM c WHERE list_has_any(list_transform(roles, lambda x: lower(x)), ['tank', 'fighter']) AND list_has_all(positions, ['JUNGLE']) AND lower(attack_type) = 'melee'")
def entity_filter(t: Tables):
    low = _one(t).withColumn("roles", F.transform("roles", F.lower))
    return N.filter_entities(low, any_of={"roles": ["tank", "fighter"]}, all_of={"positions": ["JUNGLE"]}, equal={"attack_type": "melee"}).select("record_id")


@query(f"WITH {ONE}, p AS (SELECT source, max(resource) AS r, max(attack_type) AS a FROM c GROUP BY 1) SELECT record_id, coalesce(resource, r) AS resource, coalesce(attack_type, a) AS attack_type FROM c LEFT JOIN p ON p.source = c.source")
def fill_from_parent(t: Tables):
    parent = _one(t).groupBy("source").agg(F.max("resource").alias("resource"), F.max("attack_type").alias("attack_type"))
    return N.fill_missing(_one(t).select("record_id", "source", "resource", "attack_type"), parent, "source", ["resource", "attack_type"]).select("record_id", "resource", "attack_type")


@query("SELECT record_id, count(*) AS n FROM champions GROUP BY 1 HAVING count(*) > 1")
def key_repeats(t: Tables):
    return N.repeated_keys(t.champions, "record_id")


@query(f"WITH {ONE} SELECT record_id, concat_ws('+', CASE WHEN trim(name, ' ') <> '' THEN 'name' END, CASE WHEN trim(title, ' ') <> '' THEN 'title' END, CASE WHEN cardinality(stats) > 0 THEN 'stats' END) AS fields FROM c")
def field_lineage(t: Tables):
    return _one(t).select("record_id", N.lineage({"name": F.trim("name") != "", "title": F.trim("title") != "", "stats": F.size("stats") > 0}).alias("fields"))


@query(f"WITH {ONE}, r AS (SELECT record_id, source, unnest(roles) AS role, generate_subscripts(roles, 1) AS i FROM c), d AS (SELECT record_id, lower(role) AS role, min(i) AS i FROM r WHERE role IS NOT NULL GROUP BY 1, 2) SELECT record_id, string_agg(role, ',' ORDER BY i) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY i) k FROM d) WHERE k <= 2 GROUP BY 1")
def first_roles(t: Tables):
    return _one(t).select("record_id", first_n(F.transform("roles", F.lower), 2).alias("r")).where("size(r) > 0").select("record_id", F.array_join("r", ",").alias("roles"))
