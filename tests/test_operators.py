import os

import pytest
from pyspark.sql import functions as F

from loomwright.operators import evaluation as E
from loomwright.operators import graph as G
from loomwright.operators import joins as J
from loomwright.operators import profile as P
from loomwright.operators import retrieval as V
from loomwright.operators import rules as R
from loomwright.operators import serving as S
from loomwright.operators import trainset as M
from loomwright.operators.shred import KEYED, MANY, ONE, Edge, Element, Graph, analyse, shred
from loomwright.plans import registry


def test_describe(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 5.0), ("b", None), ("c", None), ("d", float("nan"))], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in P.describe(df, ["g"], "v").collect()}
    assert got["a"] == (4, 2.5, 1.291, 1.0, 1.75, 2.5, 3.25, 4.0) and got["b"] == (1, 5.0, 0.0, 5.0, 5.0, 5.0, 5.0, 5.0) and got["c"] == got["d"] == (0, *[0.0] * 7)


def test_frequency_and_missing(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", []), ("a", None), (None, None)], "v string, l array<string>")
    assert [tuple(r) for r in P.frequency(df, "v", 5).collect()] == [("a", 2, 66.6667), ("b", 1, 33.3333)]
    assert {r["column_name"]: r["n_missing"] for r in P.completeness(df, {"v": "string", "l": "array"}).collect()} == {"v": 1, "l": 3}


def test_rules(spark):
    df = spark.createDataFrame([("Stuns and knocks up",), ("the ground is slower",), (None,)], "t string")
    assert [r[0] for r in df.select(R.tag("t", R.CONTROL)).collect()] == [["knock-up", "stun"], ["grounding"], []]
    total, why = R.score([(F.lit(True), 2.0, "a"), (F.lit(None).cast("boolean"), 5.0, "b"), (F.lit(True), -4.0, "c"), (F.lit(True), 1.0, "d")])
    assert tuple(spark.range(1).select(total, why).first()) == (-1.0, "a; c")
    assert [r[0] for r in df.select(R.tag_except("t", [("g", "ground", "slower")], upto="zzz")).collect()] == [[], [], []]


def test_joins(spark):
    a = spark.createDataFrame([("1", "", "x"), ("2", "B", None)], "k string, name string, extra string")
    b = spark.createDataFrame([("1", "A", "y"), ("3", "C", "z")], "k string, name string, role string")
    got = {r["k"]: (r["name"], r["sources_seen"]) for r in J.merge_by_precedence("k", {"a": a, "b": b}, {"name": ["a", "b"], "role": ["b"]}).collect()}
    assert got == {"1": ("A", "a+b"), "2": ("B", "a"), "3": ("C", "b")}
    names = spark.createDataFrame([(1, "Red Bolt"), (2, "red bolt"), (3, "blue bolt")], "id int, name string")
    q = spark.createDataFrame([("red bolt",), ("RED BOLT",), ("bolt",), ("none",), (None,)], "query string")
    assert {r["query"]: (r["id"], r["way"]) for r in J.fuzzy_lookup(q, names).collect()} == {"red bolt": (2, 1), "RED BOLT": (1, 2), "bolt": (1, 3), "none": (None, None), None: (None, None)}
    o = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None)], "k int, t string")
    assert [r[0] for r in J.division(o, "k", "t", ["a", "b"]).collect()] == [1]
    games = spark.createDataFrame([(1, "x", True), (1, "y", True), (1, "y", True), (2, "x", False), (2, "y", True)], "g int, c string, w boolean")
    assert [tuple(r) for r in J.basket_pairs(games, "g", "c", "w").collect()] == [("x", "y", 2, 1)]
    assert J.or_all(o, F.col("k") == 9).count() == 4 and J.or_all(o, F.col("k") == 1).count() == 2
    assert {tuple(r) for r in J.latest(spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, None, "c")], "k int, at int, v string"), ["k"], ["at"]).collect()} == {(1, 7, "b"), (2, None, "c")}


@pytest.fixture(scope="module")
def graph(spark):
    e = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "d", "u"), ("x", "y", "t"), ("a", "b", "t")], "src string, dst string, type string").distinct()
    return e


def test_graph(spark, graph):
    starts = spark.createDataFrame([("d",)], "id string")
    assert {tuple(r) for r in G.within_hops(graph, starts, 2).collect()} == {("d", 0), ("c", 1), ("b", 2)}
    assert {r["id"]: r["path"] for r in G.shortest_paths(graph, "a", 4).collect()}["d"] == ["a", "b", "c", "d"]
    assert {r["id"] for r in G.neighbours(graph, "b", "in").collect()} == {"a"} and {r["id"] for r in G.neighbours(graph, "b").collect()} == {"a", "c"}
    nodes = G.nodes((spark.createDataFrame([(1, "n", None)], "k int, a string, b string"), "k", "L", {"a": "a", "b": "b"}), (spark.createDataFrame([(1, None, "z")], "k int, a string, b string"), "k", "L", {"a": "a", "b": "b"}))
    assert [tuple(r) for r in nodes.collect()] == [("L:1", "L", {"a": "n", "b": "z"})]
    base = spark.createDataFrame([("a",), ("q",)], "id string")
    assert {r["id"]: (r["t"], r["u"]) for r in G.optional_sets(base, "id", graph, ["t", "u"]).collect()} == {"a": (["b"], []), "q": ([], [])}


def vectors(spark, n=600, d=16):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d)) + 3 * rng.normal(size=(6, d))[rng.integers(0, 6, n)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id int, vec array<float>")
    return x, c, c.where("id % 100 = 0").withColumnRenamed("id", "query_id")


def test_topk_is_exact_in_blocks(spark):
    x, c, q = vectors(spark)
    want = {i * 100: (-(x @ x[i * 100])).argsort(kind="stable")[:5].tolist() for i in range(6)}
    for block in (100, 2):
        got = {}
        for r in V.topk(c, q, 5, block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == want
    assert V.topk(c.limit(0), q, 5).count() == 0 and V.topk(c, q.limit(0), 5).count() == 0


def test_index_recall(spark):
    _, c, q = vectors(spark)
    exact = {(r["query_id"], r["id"]) for r in V.topk(c, q, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in V.Inverted(c, 8).search(q, 10, 4).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_index_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    exact, near = ({(r["query_id"], r["id"]) for r in registry.QUERIES[n](spark, path).collect()} for n in ("vector_topk", "ann_ivf"))
    assert len(exact & near) >= 0.9 * len(exact)


def test_fusion(spark):
    rows = lambda ids: spark.createDataFrame([(1, i, n + 1, 1.0 / (n + 1)) for n, i in enumerate(ids)], "query_id int, id string, rank int, score double")
    got = {r["key"]: round(r["score"], 6) for r in V.fuse({"a": rows(["x", "y"]), "b": rows(["y", "z"])}).collect()}
    assert got == {"y": 0.032522, "x": 0.016393, "z": 0.016129}
    assert {r["key"]: r["score"] for r in V.fuse({"a": rows(["x", "y"]), "b": rows([])}).collect()} == {"x": 1.0, "y": 0.5}
    assert [r["score"] for r in V.rerank(rows(["x"]), F.lit(9.0), 3).collect()] == [None]


def test_evaluation(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "z"), (None, "a")], "g string, p string")
    m = E.class_metrics(df, "g", "p")
    got = {r["label"]: (round(r["precision"], 3), r["recall"], round(r["f1"], 3)) for r in m.collect()}
    assert got == {"a": (1.0, 0.5, 0.667), "b": (0.5, 0.5, 0.5), "z": (0.0, 0.0, 0.0)}
    assert round(E.macro_f1(m).first()["macro_f1"], 4) == 0.5833
    r = E.retrieval_metrics(spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True)], "query_id int, rank int, relevant boolean")).first()
    assert (r["hit1"], r["hit3"], round(r["precision"], 6), r["rr"], round(r["ndcg"], 6)) == (0, 1, 0.666667, 0.5, 0.693426)


def test_splits_and_leaks(spark):
    df = spark.createDataFrame([(1, "A ", "train"), (2, "a", "val"), (3, "b", "train"), (4, None, "val"), (5, "", "test")], "id int, q string, split string")
    assert [r["id"] for r in M.first_of(df.select("id", "q"), F.lower(F.trim("q")), "id").orderBy("id").collect()] == [1, 3, 4, 5]
    assert [tuple(r) for r in M.leakage(df, "split", F.col("q")).collect()] == [("train", "val", 1)]
    assert [r["id"] for r in M.clean_of(df.where("split = 'train'"), df.where("split = 'val'"), F.col("q")).collect()] == [3]


def test_passages_in_two_splits_are_reported(spark, tmp_path):
    rows = [("train", "a", " Same passage"), ("val", "b", "Same passage "), ("test", "c", "same passage"), ("test", "d", "Same passage"), ("train", "e", ""), ("val", "f", None), ("test", "g", "")]
    spark.createDataFrame(rows, "split string, query string, positive string").write.parquet(f"{tmp_path}/training_triplets.parquet")
    assert registry.QUERIES["leakage_audit"](spark, str(tmp_path)).count() == 0
    got = {tuple(r) for r in registry.QUERIES["leakage_audit_passages"](spark, str(tmp_path)).collect()}
    assert got == {("train", "val", 1), ("test", "train", 1), ("test", "val", 1)}


def test_history_and_budget(spark):
    m = spark.createDataFrame([("s", "user", f"m{i}" * 100, i) for i in range(6)] + [("s", "ai", None, 9)], "k string, role string, content string, at int")
    h = S.format_history(m, "k", "role", "content", [F.desc("at")]).first()["history"].split("\n")
    assert len(h) == 3 and h[-1].startswith("user: m5") and h[0].startswith("user: m3") and h[0].endswith("...")
    b = spark.createDataFrame([("ITEM",), ("COUNTER",), ("UNKNOWN",)], "k string")
    assert [r[0] for r in b.select(S.answer_budget(F.col("k"), 600)).collect()] == [256, 600, 512]


def test_shared_inlining(spark):
    g = Graph(
        "doc", (Element("doc"), Element("part", {"name": "string"}), Element("size", {"w": "int"}), Element("note", {"t": "string"}), Element("item", {"v": "int"})),
        (Edge("doc", "part", "parts", MANY), Edge("part", "size", "size", ONE), Edge("size", "note", "notes", MANY), Edge("part", "part", "inner", MANY), Edge("doc", "item", "items", KEYED, listed=True, keys={"passive": "P"})),
    )
    tables = analyse(g)
    assert set(tables) == {"doc", "part", "note", "item"} and tables["part"].columns["size_w"] == (("size", "w"), "int")
    rows = [(1, '[{"name": "a", "size": {"w": 3, "notes": [null, {"t": "x"}]}, "inner": {"name": "b", "inner": [{"name": "c"}]}}, null]', '{"passive": {"v": 1}, "Q": [null, {"v": "no"}], "R": null}'), (2, None, "null"), (3, "7", "[1]")]
    df = spark.createDataFrame(rows, "record int, p string, i string").select("record", F.try_parse_json("p").alias("parts"), F.try_parse_json("i").alias("items"), F.lit(1).alias("path"), F.lit(2).alias("v"))
    out = shred(df, g)
    assert {tuple(r) for r in out["part"].where("record = 1").select("path", "parent_path", "name", "size_w").collect()} == {("parts/0", "", "a", 3), ("parts/0/inner/0", "parts/0", "b", None), ("parts/0/inner/0/inner/0", "parts/0/inner/0", "c", None)}
    assert [tuple(r) for r in out["note"].collect()] == [(1, "parts/0/size/notes/1", "parts/0", "part", "x")]
    assert {tuple(r) for r in out["item"].select("record", "path", "v").collect()} == {(1, "items/P/0", 1), (1, "items/Q/1", None)}


def test_index_is_stored_and_searched(spark, tmp_path):
    from loomwright.operators import pipeline as PL

    texts = ["the red dragon sleeps in the northern cave", "a merchant sells iron shields and long bows", "how to bake bread with wheat and salt", "ships leave the old harbour at dawn", "the wizard teaches a spell of frost"]
    rows = [(f"c{i}", "e", " Guide " if i % 2 else "lore", x, 1) for i, x in enumerate(texts)] + [("c0", "e", "lore", texts[0], 1), ("c9", None, None, " ", 1), (None, "e", "lore", "x", 1), ("c8", "e", None, None, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, entity_name string, chunk_type string, text string, vec int")
    path = str(tmp_path / "index")
    assert PL.build(chunks.drop("vec"), path)["types"] == {"guide": 2, "lore": 3}
    index, stats = PL.load(spark, path)
    asked = spark.createDataFrame([(1, "where does the red dragon sleep", "X"), (2, "who sells iron shields", "X"), (3, "", "X"), (4, None, None)], "query_id bigint, question string, intent string")
    best = {r["query_id"]: r["id"] for r in PL.search(index, asked, 2, stats["size"]).where("rank = 1").collect()}
    assert best == {1: "c0", 2: "c1"}
    none = PL.search(index, asked, 2, stats["size"], exclude={"X": ["lore", "guide"]})
    assert none.count() == 0
    assert PL.build(chunks.drop("vec").limit(0), str(tmp_path / "none"))["n"] == 0 and PL.load(spark, str(tmp_path / "none"))[0].count() == 0


def test_index_of_long_texts_and_blank_types_is_built_soon(spark, tmp_path):
    import time

    from loomwright.operators import pipeline as PL

    kind = "case pmod(id, 3) when 0 then 'lore' when 1 then ' ' end chunk_type"
    chunks = spark.range(600).selectExpr("concat('c', id) chunk_id", "'e' entity_name", kind, "array_join(transform(sequence(1, 80), i -> concat('w', pmod(i * id, 97))), ' ') text")
    began, path = time.time(), str(tmp_path / "index")
    assert PL.build(chunks, path)["types"] == {"lore": 200, "none": 400}
    rows, stats = PL.load(spark, path)
    assert {r["chunk_type"]: r["n"] for r in rows.groupBy("chunk_type").agg(F.count("*").alias("n")).collect()} == {"lore": 200, "": 200, None: 200}
    assert time.time() - began < 60


def test_fallback_ladder_answers_every_request_once(spark):
    from loomwright.operators import traversal as T

    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "key int, kind string")
    one = lambda ids: lambda q: q.where(q["key"].isin(*ids)).select("key")
    got = {r["key"]: r["strategy"] for r in T.answer(asked, "key", "kind", {"a": one([1]), "b": one([])}, [("near", one([2, 1])), ("far", one([3]))]).collect()}
    assert got == {1: "a", 2: "near", 3: "far", 4: "none"}
