import random

from loomwright.llm import leaks as K

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(RNG.randint(1, 4))) for _ in range(800)]


def words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def test_whole_with_edits_runs_and_no_cases():
    passages = {i: words(72) for i in range(30)}
    items = K.Items([(i, " ".join(w)) for i, w in passages.items()])
    for i, w in passages.items():
        edited = list(w)
        for k in RNG.sample(range(72), 9):  # fewer than one word in six
            edited[k] = "changed" if RNG.random() < 0.5 else edited[k] + " added"
        around = f"{' '.join(words(60))}. <p>“{' '.join(edited).upper()}”</p> {' '.join(words(40))}"
        assert items.leaked(around) == [i]
        a = RNG.randrange(60)
        assert i in items.leaked(" ".join([*words(50), *w[a : a + 12], *words(50)]))
        assert items.leaked(" ".join([*words(50), *w[a : a + 11], "other", *words(50)])) == []
        half = [x if RNG.random() < 0.6 else RNG.choice(VOCABULARY) for x in w]
        longest = max(len(r) for r in "".join("1" if x == y else " " for x, y in zip(half, w, strict=True)).split())
        if longest < 12:
            assert items.leaked(" ".join(half)) == []


def test_long_passages_with_only_additions_changes_or_gaps():
    """72 to 2,000 words, as many edits as allowed at once; added words are long and shift the characters far."""
    for n in (72, 200, 600, 900, 2000):
        for how in ("added", "changed", "mixed"):
            w = words(n)
            items, edited = K.Items([(7, " ".join(w)), (8, " ".join(words(n)))]), list(w)
            for k in sorted(RNG.sample(range(1, n), n // 6), reverse=True):
                if how == "added" or how == "mixed" and RNG.random() < 0.5:
                    edited.insert(k, "x" * RNG.choice([1, 5, 40]))
                else:
                    edited[k] = "y" * RNG.choice([1, 5, 40])
            assert items.leaked(" ".join([*words(50), *edited, *words(300)])) == [7], (n, how)
            if how == "changed":  # every sixth word and the last: one edit too many, no run of 12 words
                edited = ["zz" if k % 6 == 5 or k == n - 1 else x for k, x in enumerate(w)]
                assert sum(a != b for a, b in zip(edited, w, strict=True)) == n // 6 + (n % 6 > 0)
                assert items.leaked(" ".join(edited)) == ([7] if n % 6 == 0 else [])


def brute(passage, text):
    """p8 by plain dynamic programming over all words, and all runs."""
    a, b = K.words_of(passage), K.words_of(text)
    runs = {tuple(b[i : i + 12]) for i in range(len(b) - 11)}
    if any(tuple(a[i : i + 12]) in runs for i in range(len(a) - 11)):
        return True
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) <= len(a) // 6


def test_brute_force_on_mixed_texts(spark):
    """Copies with edits around the bound, in one scan and by the join of q-grams."""
    passages = {i: words(RNG.choice([6, 13, 40, 72])) for i in range(12)}
    texts = {}
    for d in range(60):
        w = list(passages[RNG.randrange(12)])
        for k in sorted(RNG.sample(range(len(w)), min(len(w), RNG.randint(0, len(w) // 5 + 1))), reverse=True):
            w[k : k + 1] = RNG.choice([[], ["other"], [w[k], "addedword"]])
        texts[d] = " ".join([*words(RNG.randint(0, 30)), *w, *words(RNG.randint(0, 30))])
    want = {(d, i) for d, t in texts.items() for i, p in passages.items() if brute(" ".join(p), t)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in passages.items()], "item_id bigint, passage string")
    assert 20 < len(want) < 60
    for block in (K.BLOCK_CHARS, 10):
        assert {tuple(r) for r in K.leaks(docs, items, block).collect()} == want


def test_markup_and_marks_do_not_count():
    assert K.words_of("<b>Kar</b>st-on-Wyre&nbsp;Café’s​ x") == ["karst", "on", "wyre", "cafes", "x"]
    assert K.words_of(None) == [] and K.words_of("") == []


def test_rows_blocks_and_edges(spark):
    p = " ".join(words(40))
    items = spark.createDataFrame([(1, p, 1), (1, p, 1), (2, None, 1), (3, "", 1), (None, p, 1), (4, " ".join(words(30)), 1)], "item_id bigint, passage string, doc_id int")
    docs = spark.createDataFrame([(1, p, 0), (2, None, 0), (3, "", 0), (4, "x", 0), (5, "z " * 100_000 + p, 0)], "doc_id bigint, text string, item_id int")
    for block in (10_000_000, 100):
        assert {tuple(r) for r in K.leaks(docs, items, block).collect()} == {(1, 1), (5, 1)}
    assert K.leaks(docs.limit(0), items).count() == 0 and K.leaks(docs, items.limit(0)).count() == 0
