"""p4: nested champion records as flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.shred import KEYED, MANY, ONE, Edge, Element, Graph, shred
from loomwright.session import read_table

LETTERS = {"p": "P", "passive": "P", "q": "Q", "w": "W", "e": "E", "r": "R"}
NUMBERS = {"flat": "double", "perLevel": "double", "percent": "double", "percentPerLevel": "double"}
TEXTS = dict.fromkeys(("name", "description", "projectile", "spellshieldable", "onHitEffects", "damageType", "notes"), "string")

GRAPH = Graph(
    "champion",
    (
        Element("champion"),
        Element("stat", NUMBERS),
        Element("ability", TEXTS),
        Element("cooldown"),
        Element("effect", {"description": "string"}),
        Element("leveling", {"attribute": "string"}),
        Element("modifier", {"values": "array<double>", "units": "array<string>"}),
    ),
    (
        Edge("champion", "stat", "stats", KEYED),
        Edge("champion", "ability", "abilities", KEYED, listed=True, keys=LETTERS),
        Edge("champion", "effect", "effects", KEYED, listed=True, keys=LETTERS),
        Edge("ability", "cooldown", "cooldown", ONE),
        Edge("cooldown", "modifier", "modifiers", MANY),
        Edge("effect", "leveling", "leveling", MANY),
        Edge("leveling", "modifier", "modifiers", MANY),
    ),
)


def champion_tables(champions: DataFrame) -> dict[str, DataFrame]:
    """Tables stat, ability, effect, leveling and modifier (of levelings and of cooldowns).

    ``effects`` may be encoded twice; text that is no JSON, or JSON that is no object, counts as absent.
    """
    once = F.try_parse_json("effects")
    again = F.try_parse_json(F.try_variant_get(once, "$", "string"))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    records = champions.select(
        F.col("record_id").alias("record"),
        F.when(F.col("stats").isNotNull(), F.to_variant_object("stats")).alias("stats"),
        F.when(F.col("abilities").isNotNull(), F.to_variant_object("abilities")).alias("abilities"),
        F.when(is_object(once), once).when(is_object(again), again).alias("effects"),
    )
    return shred(records, GRAPH)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = champion_tables(read_table(spark, sf_dir, "champions"))
    tables["modifier"] = tables["modifier"].where(F.col("parent_kind") == "leveling")
    rows = [t.select(F.col("record").alias("record_id"), F.lit(k).alias("node_kind"), F.col("path").alias("node_path")) for k, t in tables.items()]
    return reduce(DataFrame.unionByName, rows).distinct()


def _table(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = champion_tables(read_table(spark, sf_dir, "champions"))[name]
        lists = [c for c, kind in t.dtypes if kind.startswith("array")]
        return t.withColumns({c: F.to_json(c) for c in lists}).withColumnRenamed("record", "record_id").distinct()

    return query


def _listed(x: str) -> str:
    """SQL: the elements of a JSON list, or a single value as a list of one."""
    return f"CASE WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN [] ELSE [{x}] END"


def _unnested(source: str, path: str, x: str) -> str:
    return f"SELECT record_id, {path} || '/' || (i - 1) AS path, l[i] AS v FROM (SELECT record_id, path, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT record_id, path, {_listed(x)} AS l FROM {source}))"


LETTER = "CASE lower(trim(k)) WHEN 'p' THEN 'P' WHEN 'passive' THEN 'P' WHEN 'q' THEN 'Q' WHEN 'w' THEN 'W' WHEN 'e' THEN 'E' WHEN 'r' THEN 'R' ELSE k END"
REAL = "v IS NOT NULL AND json_type(v) <> 'NULL'"
FOUND_SQL = f"""WITH st AS (SELECT record_id, unnest(map_entries(stats)) AS x FROM champions), ab AS (SELECT record_id, unnest(map_entries(abilities)) AS x FROM champions),
ai AS (SELECT record_id, x.key AS k, unnest(range(1, len(x.value) + 1)) AS i, x.value AS l FROM ab),
j0 AS (SELECT record_id, CASE WHEN json_valid(effects) THEN effects::JSON END AS j FROM champions),
j1 AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j ->> '$') THEN (j ->> '$')::JSON ELSE j END AS j FROM j0),
e0 AS (SELECT record_id, unnest(json_keys(j)) AS k, j FROM j1 WHERE json_type(j) = 'OBJECT'),
e1 AS (SELECT record_id, 'effects/' || {LETTER} AS path, json_extract(j, '$."' || k || '"') AS v FROM e0),
e AS (SELECT * FROM ({_unnested("e1", "path", "v")}) WHERE {REAL}), l0 AS (SELECT record_id, path || '/leveling' AS path, json_extract(v, '$.leveling') AS v FROM e),
l AS (SELECT * FROM ({_unnested("l0", "path", "v")}) WHERE {REAL}), m0 AS (SELECT record_id, path || '/modifiers' AS path, json_extract(v, '$.modifiers') AS v FROM l), m AS (SELECT * FROM ({_unnested("m0", "path", "v")}) WHERE {REAL})
SELECT DISTINCT record_id, 'stat' AS node_kind, 'stats/' || x.key AS node_path FROM st WHERE x.value IS NOT NULL UNION SELECT record_id, 'ability', 'abilities/' || {LETTER} || '/' || (i - 1) FROM ai WHERE l[i] IS NOT NULL
UNION SELECT record_id, 'effect', path FROM e UNION SELECT record_id, 'leveling', path FROM l UNION SELECT record_id, 'modifier', path FROM m"""

ORACLES = {"p4_found": FOUND_SQL}
QUERIES = {"p4_found": p4_found} | {f"p4_{n}s": _table(n) for n in ("stat", "modifier", "leveling")}
QUERIES |= {"p4_abilities": _table("ability"), "p4_effects": _table("effect")}
