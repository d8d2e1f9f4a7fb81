import datetime as dt

from loomwright.llm import answers as X

T0 = dt.datetime(2024, 5, 1)


def test_features_tell_defects():
    assert X.ending("It ends here. 👍") == "stop" and X.ending("it breaks off in the mid") == "letter"
    assert X.ending("```\na -> ") == "fence" and X.ending("List:\n1. a\n2.") == "marker" and X.ending('he said "go"') == "closed"
    assert X.language("Die Siegesrate liegt bei 55 % aus 286 Spielen und das ist gut") == "de"
    assert X.language("我们队昨天打得非常谨慎。") == "zh" and X.language("12345") == ""
    assert X.asked_for("Please answer this in German - what is it?") == {"de"}


def test_pairs_skip_system_and_repeats(spark):
    rows = [(1, "s", "user", "q", None, T0), (2, "s", "system", "x", None, T0), (3, "s", "AI", "a", None, T0), (3, "s", "AI", "a", None, T0), (4, "s", "ai", "b", None, T0), (5, None, "ai", "b", None, T0), (6, "s", "ai", "b", None, None)]
    df = spark.createDataFrame(rows, "id bigint, session_id string, role string, content string, rag_meta string, created_at timestamp_ntz")
    assert [(r["id"], r["q"], r["a"]) for r in X.answer_pairs(df).collect()] == [(3, "q", "a")]


def test_held_out_accuracy(spark, small):
    """Trained on one table, tested on defects made from another."""
    import random

    pairs = lambda p: [tuple(r) for r in X.answer_pairs(spark.read.parquet(p)).collect()]
    model = X.train(pairs(small.replace("sf0.001", "sf0.01") + "/lol_chat_messages.parquet"))
    held = pairs(f"{small}/lol_chat_messages.parquet")
    good = [r for r in held if model.predict([r[1:]]) == [None]]
    assert len(good) > 0.8 * len(held)
    rng, right, total = random.Random(1), 0, 0
    others = {"de": ["Die Siegesrate liegt bei 55.9 % aus 286 Spielen. Warte in der Lane, bis er den Angriff benutzt hat."], "en": ["You can track the jungler and then call your jungler, because they win the late game."]}
    for _, q, a, meta in good:
        for label in X.LABELS:
            bad = X.damage(rng, label, q or "", a or "", others)
            if bad is not None:
                total += 1
                right += model.predict([(q, bad, meta)]) == [label]
    assert total > 100 and right / total > 0.9


def test_no_rows_and_odd_rows(spark):
    df = spark.createDataFrame([], "id bigint, q string, a string, meta string")
    assert X.defects(df).count() == 0
    rows = [(i, None, None, "{") for i in range(6)] + [(7, "q" * 60_000, "a " * 60_000, None)]
    got = {r["answer_id"]: r["defect"] for r in X.defects(spark.createDataFrame(rows, "id bigint, q string, a string, meta string")).collect()}
    assert set(got) <= set(range(8)) and all(v in X.LABELS for v in got.values())
