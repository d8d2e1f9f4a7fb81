import random

import numpy as np
from pyspark.sql import functions as F

from loomwright.llm import pii as X

CASES = [
    "Send replays to ilse1993@duskbox.invalid before Friday. My name is Livia Wexisto and I main Dolteres.",
    "Tel: +44 (0)7700 900 566 and the replay code is 959-31-6761, valid for one patch.",
    "They posted SSN 967-30-2348 (leaked). Skin bundle 1234-2920-4207 is a shop code.",
    "I moved to 221 North Harrowgate Blvd, Suite 254 last split. Ship the jersey to Marlpitstraße 215.",
    "Best regards,\nVelquist, Sofia\nRegards from Belvasin! Ping @jungle_main on the boards. Lobby 5550569 crashed twice.",
]


def test_spans_exactly_as_they_stand(spark, small):
    base = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "entity_name")
    extra = spark.createDataFrame([(10_000 + i, c, None) for i, c in enumerate(CASES)], "doc_id bigint, text string, entity_name string")
    docs = base.unionByName(extra)
    got = {(r["doc_id"] - 10_000, r["pii_type"], r["pii_text"]) for r in X.found(docs).where("doc_id >= 10000").collect()}
    assert got == {
        (0, "email", "ilse1993@duskbox.invalid"), (0, "name", "Livia Wexisto"), (1, "phone", "+44 (0)7700 900 566"), (2, "identity", "967-30-2348"),
        (3, "address", "221 North Harrowgate Blvd, Suite 254"), (3, "address", "Marlpitstraße 215"), (4, "name", "Velquist, Sofia"),
    }


#: Names, streets and sentences that occur in no table.
HELD = {
    "name": (
        ["Kwame Mensah", "Priya Raman", "Dmytro Kovalenko", "Aoife Gallagher", "Ngozi Okafor", "Tariq Haddad", "Ximena Rojas", "Bartosz Wrona", "Henrike Vogelsang", "Thabo Nkosi", "Leilani Kahale", "Rashid Karimov", "Solveig Aasen", "Eszter Szabo", "Milos Petrovic", "Yewande Adeyemi"],
        ["My colleague {} met the sponsors yesterday.", "I spoke with {} about the contract.", "The minutes were signed by {} in March.", "{} said the venue was too small.", "Please ask Dr. {} for the results.", "Hello, my name is {} and I am new here.", "Ticket owner: {}, phone to follow.", "Yours sincerely, {}", "{} wrote the first draft.", "Her brother {} lives abroad."],
    ),
    "email": (["kmensah@harbour.org", "p.raman@mill-lane.net", "dk_77@posteo.de", "aoife@quay.io"], ["Write to {} for the slides.", "You may mail {} at once.", "E-mail: {}"]),
    "phone": (["+49 30 901820", "(312) 555-7788", "020 7946 0991", "+33 1 40 20 50 50"], ["Ring me: phone {}.", "Call {} after lunch.", "Our mobile number is {}."]),
    "address": (["12 Baker Street", "Lindenallee 44", "7b Mill Lane", "25 rue Mouffetard"], ["They live at {}.", "The parcel goes to {}.", "Office address: {}"]),
}
PLAIN = ["The Silver Tower stands above Old Harbour.", "Bring the Iron Shield to the Crystal Gate at dawn.", "Version 12.4.1 shipped on 3 May 2021.", "Copper Kettle sells 250 cakes a day.", "The Grand Canal froze in Winter Storm Nine.", "Green Dragon beats Red Wyvern in 40 seconds.", "Order 1048576 has 12 lines.", "Nobody knows why the Golden Lion sleeps.", "Blue Falcon deals 300 damage."]


def test_names_and_sentences_that_occur_in_no_table(spark, small):
    rng = random.Random(9)
    rows, want = [], set()
    for i in range(400):
        parts = rng.choices(PLAIN, k=3)
        for kind in rng.sample(sorted(HELD), 2):
            spans, sentences = HELD[kind]
            s = rng.choice(spans)
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(sentences).format(s) + ("\n" if rng.random() < 0.2 else ""))
            want.add((i, kind, s))
        rows.append((i, " ".join(parts), None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, entity_name string")
    got = {tuple(r) for r in X.found(docs).select("doc_id", "pii_type", "pii_text").collect()}
    for kind in HELD:
        w, g = {x for x in want if x[1] == kind}, {x for x in got if x[1] == kind}
        print(kind, "recall", round(len(w & g) / len(w), 3), "precision", round(len(w & g) / max(1, len(g)), 3), sorted({x[2] for x in g - w})[:9], sorted({x[2] for x in w - g})[:9])
        assert len(w & g) >= 0.9 * len(w) and len(w & g) >= 0.9 * len(g)
    own = spark.read.parquet(f"{small}/documents.parquet").agg(F.concat_ws(" ", F.collect_list("text"))).first()[0].lower()
    assert not any(w.lower() in own for n in HELD["name"][0] for w in n.split())


def test_placeholders_keep_the_rest(spark):
    docs = spark.createDataFrame([(1, "mail a@b.de now 🙂 to Jo", "x"), (2, None, "x"), (3, "", "x")], "doc_id bigint, text string, start string")
    s = spark.createDataFrame([(1, "email", 5, 11, "a@b.de"), (1, "name", 21, 23, "Jo")], "doc_id bigint, pii_type string, start int, stop int, pii_text string")
    assert {r["doc_id"]: r["text"] for r in X.redacted(docs, s).collect()} == {1: "mail [EMAIL] now 🙂 to [NAME]", 2: None, 3: ""}


def test_labelers_are_weighed():
    marks, n = ["++....", "-..-..", "+.-...", "-.-.-."], np.array([50.0, 30.0, 20.0, 60.0])
    p = X.reliabilities(marks, n)
    assert p[0] > 0.9 and p[3] < 0.1


def test_empty_null_and_long(spark):
    schema = "doc_id bigint, text string, entity_name string, pii_type int, start int"
    assert X.found(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, 1, 1), (2, "", "x", 1, 1), (3, "12 " * 30_000, None, 1, 1), (4, "a@b.example " * 2000, None, 1, 1)]
    assert X.found(spark.createDataFrame(rows, schema)).where("doc_id = 4").count() == 2000
