from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import pieces as S


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n。é🙂", max_size=400), st.integers(1, 60), st.integers(0, 70))
def test_pieces_cover_the_text(text, most, overlap):
    kind, parts = S.split(text, most, overlap)
    o = max(0, min(overlap, most - 1))
    assert kind in S.KINDS and parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, z, _), (b, _, _) in zip(parts, parts[1:], strict=False):
        assert z - a <= most and b == max(0, z - o)
    if len(text) > most - o:
        assert parts[-1][1] - parts[-1][0] <= most
    assert all(S.KINDS.index(c) <= S.KINDS.index(kind) for _, _, c in parts[:-1])


def test_edit_changes_neighbours_only():
    text = ". ".join(f"Sentence number {i * 7919 % 1000} is about {i * 31 % 97} things" for i in range(400))
    a = {text[x:y] for x, y, _ in S.split(text, 800, 80)[1]}
    changed = text[:9000] + " some words put in" + text[9000:]
    b = {changed[x:y] for x, y, _ in S.split(changed, 800, 80)[1]}
    assert len(a - b) <= 4


def test_kinds():
    assert S.split("a a. b b.\n\nc c. d d.", 12, 2)[0] == "paragraph"
    assert S.split("aaa aa. bbb bb. ccc cc.", 12, 2)[0] == "sentence"
    assert S.split("aaa bbb ccc ddd eee fff", 12, 2)[0] == "word"
    assert S.split("a" * 50, 12, 2)[0] == "none"
    assert S.split("我们赢了。我们赢了。我们赢了。", 8, 2)[0] == "sentence"


def test_limits_nulls_and_repeats(spark):
    limits = spark.createDataFrame([("lore", 10, 2, "x"), ("default", 20, 4, "x")], "chunk_type string, max_chars int, overlap_chars int, text string")
    rows = [("a", "word " * 5, " Lore "), ("a", "word " * 5, " Lore "), ("b", "word " * 5, None), ("c", "short", "lore"), ("d", None, "lore"), ("e", "", "?"), ("f", "y" * 200_000, "lore"), (None, "word " * 9, "x")]
    chunks = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id string, text string, chunk_type string, piece int")
    got = S.pieces(chunks, limits).where("piece = 0").select("chunk_id", "boundary").distinct()
    assert {tuple(r) for r in got.collect()} == {("a", "word"), ("b", "word"), ("f", "none"), (None, "word")}
    assert S.pieces(chunks.limit(0), limits).count() == 0
