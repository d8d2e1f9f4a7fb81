from pyspark.sql import functions as F

from loomwright.functions import arrays as A
from loomwright.functions import numeric as N
from loomwright.functions import text as X


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_numbers(spark):
    r = one(spark, N.smoothed_rate(F.lit(12), F.lit(20)), N.smoothed_rate(F.lit(0), F.lit(0)), N.growth(F.lit(600.0), F.lit(100.0), F.lit(1)), N.digits(N.growth(F.lit(600.0), F.lit(100.0), F.lit(2)), 2), N.digits(N.growth(F.lit(600.0), F.lit(100.0), F.lit(18)), 2), N.sigmoid(F.lit(0.0)), N.sigmoid(F.lit(100.0)), N.safe_ratio(F.lit(1), F.lit(0)), N.digits(F.lit(2.00005)))
    assert [round(x, 9) for x in list(r)[:5]] == [55.0, 50.0, 600.0, 672.0, 2300.0] and r[5] == 0.5 and abs(r[6] - 1) < 1e-12 and r[7] == 0.0 and r[8] == 2.0001


def test_token_sizes_and_cuts(spark):
    rows = spark.createDataFrame([("",), ("abc",), ("abcd",), ("é",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.token_estimate("t")).collect()] == [0, 1, 2, 1, 0]
    long = spark.createDataFrame([("a" * 500,), ("é" * 300,), ("short",), (None,), ("🙂" * 100_000,)], "t string")
    got = [r[0] for r in long.select(X.truncate_tokens("t", 100)).collect()]
    assert got[0] == "a" * 297 + "..." and got[1] == "é" * 148 + "..." and got[2:4] == ["short", None]
    assert all(len(x.encode()) <= 300 for x in got if x)


def test_text(spark):
    r = one(spark, X.clean_html(F.lit("<b>a</b>  b<br>c")), X.normalize_key(F.lit("Dr. Foo-Bar's")), X.capitalize(F.lit("dR. K'SANTE")), X.word_count(F.lit("  a  b ")), X.word_count(F.lit("  ")), X.json_in_text(F.lit('x ```json\n{"a": {"b": 1}}``` y')), X.resolve_tokens(F.lit("deals @dmg@ {{ x }} now"), {"dmg": "5"}), X.clean_html_paragraphs(F.lit("<p>a<br>b</p><p> c </p>")), X.drop_block(F.lit("a<stats>x\ny</stats>b"), "stats"))
    assert list(r) == ["a b c", "drfoobars", "Dr. k'sante", 2, 0, '{"a": {"b": 1}}', "deals 5 now", "a\nb\n\nc", "a b"]
    assert one(spark, X.aliases(F.lit("Lunar Chalice")))[0] == ["lunarchalice", "lunar", "chalice", "lc"]
    assert one(spark, X.unescape(F.lit("Mur&#39;xemon &amp; co")))[0] == "Mur'xemon & co"


def test_lists(spark):
    df = spark.createDataFrame([(["X", "Y"], ["P"]), (["X"], ["P"]), (None, None), ([], [])], "e array<string>, p array<string>")
    assert [r[0] for r in df.select(A.has_all("e", ["X", "Y"]) & A.has_any("p", ["P", "Q"])).collect()] == [True, False, False, False]
    r = one(spark, A.first_present(F.lit(""), F.lit(None).cast("string"), F.lit("c")), A.first_present(F.lit(0), F.lit(3), kind="number"), A.keep_known(F.array(F.lit("B"), F.lit("a"), F.lit("z")), ["A", "b"]), A.first_n(F.array(F.lit("x"), F.lit(None), F.lit("x"), F.lit("y")), 2), A.labels((F.lit(True), "b"), (F.lit(True), "a"), (F.lit(False), "c")))
    assert list(r) == ["c", 3, ["B", "a"], ["x", "y"], ["a", "b"]]
