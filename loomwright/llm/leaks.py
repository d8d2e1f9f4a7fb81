"""p8: passages of evaluation items inside documents, by q-gram filtering and banded alignment.

Both sides are reduced to lower-case words: markup, entities, accents, invisible characters and punctuation
don't count. Characters of a document are matched with those of all items by their q-grams; each match lies on
a diagonal: the word it begins in, counted in the document, minus that counted in the item. A whole passage with at
most e changed, added or lacking words stays on e + 1 neighbouring diagonals, whatever the words' lengths, and by the
q-gram lemma keeps at least so many q-grams there; overlapping bands of 2 (e + 1) diagonals hold any of these
stretches. A run of words keeps all of its q-grams on one diagonal. Regions with fewer can't be cases. The others are
verified: a whole passage by alignment of the words within the band, a run by comparing the words. Of each passage
only q-grams that few items have are counted, as many as leave bounds of ``ENOUGH``, if all of its q-grams do.

Items of up to ``BLOCK_CHARS`` characters are held by every task; more are joined by q-grams in the cluster.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import read_table, through_table

Q = 6
RUN = 12  # running words of a passage that make a leak
ONE_IN = 6  # words of which one may be changed or added in a whole passage
ENOUGH = 8  # q-grams that a region should have to be looked at
#: Characters of passages that every task may hold; more items are joined by q-grams.
BLOCK_CHARS = 8_000_000
CHUNK = 1 << 18  # characters of documents that are searched at a time; a longer text is searched by itself, whole

INLINE = regex.compile(r"</?(?:a|abbr|b|big|code|em|font|i|mark|s|small|span|strong|sub|sup|u|wbr)(?:\s[^<>]*)?/?>", regex.I)
TAG = regex.compile(r"<[!/]?[a-zA-Z][^<>]*>|<!--.*?-->", regex.S)
DROP = regex.compile(r"[\p{M}\p{Cf}'’ʼ`´*]")
WORD = regex.compile(r"[^\W_]+")
MULTIPLIER = 1_000_003


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text without markup, accents, invisible characters and marks. Null: none."""
    if not text:
        return []
    if "<" in text:
        text = TAG.sub(" ", INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = TAG.sub(" ", INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return WORD.findall(DROP.sub("", text).casefold())


def hashes(text: str) -> np.ndarray:
    """Hash of the Q characters at each position of text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("uint64")
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, "uint64")
    h = np.zeros(n, "uint64")
    for k in range(Q):
        h = h * np.uint64(MULTIPLIER) + codes[k : k + n]
    return h


def _joined(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q-grams of all texts, one after the other, with the number of the text and of the word each begins in."""
    sizes = np.array([len(w) + 1 for t in texts for w in t], "int64")
    n = np.array([len(t) for t in texts], "int64")
    first = np.cumsum(n) - n
    h = hashes("\n".join(" ".join(t) for t in texts if t))  # no word holds a line break, so no q-gram of two texts matches
    text = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(np.arange(len(sizes)), sizes)[: len(h)]
    return h, text[at], at - first[text[at]]


def bounds(w: list[str], mask: np.ndarray | None = None) -> tuple[int, int]:
    """The q-grams that at least remain of a whole passage within its edits, and of a run of it; 1 at least.

    ``mask``: which of the q-grams count, in place of all.
    """
    sizes, e = np.array([len(x) for x in w], "int64"), len(w) // ONE_IN
    ends = np.cumsum(sizes + 1) - 1
    n = max(0, int(ends[-1]) - Q + 1)
    before = np.r_[0, np.cumsum(np.ones(n, "int64") if mask is None else mask)]
    between = lambda a, z: before[np.clip(z, 0, n)] - before[np.clip(a, 0, n)]
    lost = between(ends - sizes - Q + 1, ends)  # by an edit of each word
    whole = int(before[-1]) - int(np.sort(lost)[::-1][:e].sum())
    if len(w) < RUN:
        return max(1, whole), 1 << 40
    first, last = (ends - sizes)[: len(w) - RUN + 1], ends[RUN - 1 :] - Q + 1
    return max(1, whole), max(1, int(between(first, np.maximum(first, last)).min()))


class Items:
    """The q-grams of all passages, sorted, with the items and words where they stand."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        words = {i: w for i, t in rows if (w := words_of(t))}
        self.ids = sorted(words)
        self.codes: dict[str, int] = {}
        passages = [words[i] for i in self.ids]
        self.passages = [np.array([self.codes.setdefault(w, len(self.codes)) for w in p]) for p in passages]
        self.edits = np.array([len(p) // ONE_IN for p in passages], "int64")
        g, item, word = _joined(passages)
        _, back, often = np.unique(g, return_inverse=True, return_counts=True)
        often, used = often[back], np.zeros(len(g), bool)
        ends = np.cumsum([sum(map(len, p)) + len(p) for p in passages])
        self.whole, self.run = np.empty(len(passages), "int64"), np.empty(len(passages), "int64")
        for k, (p, z) in enumerate(zip(passages, ends.tolist(), strict=True)):
            a, z = z - sum(map(len, p)) - len(p), z - Q  # without the q-grams that reach into the next passage
            mine = often[a:z]
            for most in [1 << i for i in range(int(mine.max(initial=1)).bit_length() + 1)]:
                mask = mine <= most
                self.whole[k], self.run[k] = bounds(p, mask)
                if self.whole[k] >= ENOUGH and self.run[k] >= ENOUGH:
                    break
            used[a : max(a, z)] = mask
        order = np.flatnonzero(used)
        order = order[np.argsort(g[order], kind="stable")]
        self.item, self.word = item[order], word[order]
        self.gram, self.start, self.count = np.unique(g[order], return_index=True, return_counts=True)

    def regions(self, texts: list[list[str]]) -> dict[tuple[int, int], list[tuple[int, bool]]]:
        """(text, item index) -> diagonals with enough q-grams, and whether a band for a whole passage begins there."""
        h, text, word = _joined(texts)
        if not len(h) or not len(self.gram):
            return {}
        at = np.minimum(np.searchsorted(self.gram, h), len(self.gram) - 1)
        hit = np.flatnonzero(self.gram[at] == h)
        if not len(hit):
            return {}
        n = self.count[at[hit]]
        first = np.repeat(self.start[at[hit]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item, hit = self.item[first], np.repeat(hit, n)
        diagonal = word[hit] - self.word[first]
        both = text[hit] * len(self.ids) + item
        out: dict[tuple[int, int], list[tuple[int, bool]]] = {}
        low = int(diagonal.min())
        width = int(diagonal.max()) - low + 3

        def enough(key: np.ndarray, bound: np.ndarray, whole: bool) -> None:
            key, found = np.unique(key, return_counts=True)
            pair = key // width
            good = found >= bound[pair % len(self.ids)]
            for p, x in zip(pair[good].tolist(), (key[good] % width).tolist(), strict=True):
                t, k = divmod(p, len(self.ids))
                step = int(self.edits[k]) + 1
                out.setdefault((t, k), []).append(((x - 1) * step + low, True) if whole else (x + low, False))

        enough(both * width + diagonal - low, self.run, False)
        band = (diagonal - low) // (self.edits[item] + 1)
        enough(np.concatenate([both * width + band, both * width + band + 1]), self.whole, True)
        return out

    def found(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(number of the text, id of the item) of all texts that hold an item's passage whole or in a run."""
        out, codes = [], {}
        for (t, k), spots in self.regions(texts).items():
            if t not in codes:
                codes[t] = np.array([self.codes.get(w, -1) for w in texts[t]])
            doc, passage = codes[t], self.passages[k]
            if any(aligned(passage, doc, d, int(self.edits[k])) if whole else running(passage, doc, d) for d, whole in spots):
                out.append((t, self.ids[k]))
        return out

    def leaked(self, text: str | None) -> list[int]:
        """Ids of the items whose passage one text holds."""
        return sorted(i for _, i in self.found([words_of(text)]))


def running(passage: np.ndarray, doc: np.ndarray, diagonal: int) -> bool:
    """Whether RUN running words are equal on a diagonal."""
    a, z = max(0, -diagonal), min(len(passage), len(doc) - diagonal)
    if z - a < RUN:
        return False
    other = np.flatnonzero(passage[a:z] != doc[a + diagonal : z + diagonal])
    return bool(np.diff(np.r_[-1, other, z - a]).max() > RUN)


def aligned(passage: np.ndarray, doc: np.ndarray, low: int, edits: int) -> bool:
    """Whether the passage stands in doc with at most so many changed, added or lacking words.

    Alignment of the whole passage with any stretch of doc, in the band of 2 (edits + 1) diagonals from ``low`` on.
    """
    width, n, far = 2 * (edits + 1), len(passage), edits + 1
    place = np.arange(width)
    part = np.full(n + width - 1, -2)  # word j of the band's part is word low + j of doc
    a, z = max(0, low), min(len(doc), low + len(part))
    if a < z:
        part[a - low : z - low] = doc[a:z]
    row = np.zeros(width, "int64")  # any start is free
    for i in range(n):
        new = row + (part[i : i + width] != passage[i])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - place) + place
        if row.min() >= far:
            return False
    return True


def _search(rows: list[tuple[int, str]]) -> Callable:
    """A function for mapInArrow over (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(rows)
        for batch in batches:
            ids, out, texts, size, base = batch.column(0), [], [], 0, 0
            for n, text in enumerate(batch.column(1)):
                texts.append(words_of(text.as_py()))
                size += sum(map(len, texts[-1]))
                if size > CHUNK or n == len(ids) - 1:
                    out += [(base + t, i) for t, i in known.found(texts)]
                    texts, size, base = [], 0, n + 1
            where = pa.array([t for t, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(where), pa.array([i for _, i in out], pa.int64())], ["doc_id", "item_id"])

    return run


def _grams(frame: DataFrame, key: str, text: str) -> DataFrame:
    """key, gram: the different q-grams of each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, t in zip(f["k"], f["t"], strict=True):
                g = np.unique(hashes(" ".join(words_of(t)))).view("int64")
                if len(g):
                    yield pd.DataFrame({key: k, "gram": g})

    kind = frame.schema[key].dataType.simpleString()
    return frame.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, gram bigint")


def chosen_grams(items: DataFrame, often: DataFrame) -> DataFrame:
    """item_id, gram: so many of the rarest q-grams of each passage that one of them remains in every case.

    Of a whole passage one more than its edits can spoil, and the rarest of each run of words. ``often``: gram, n.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, passage, grams, counts in zip(f["item_id"], f["passage"], f["grams"], f["counts"], strict=True):
                w, n = words_of(passage), dict(zip(grams, counts, strict=True))
                h, _, word = _joined([w])
                h = h.view("int64")
                rare = np.array([n.get(x, 0) for x in h.tolist()])
                order = np.argsort(rare, kind="stable")
                take = set(order[: len(h) - bounds(w)[0] + 1].tolist())
                starts = np.searchsorted(word, np.arange(len(w)))
                ends = np.r_[np.cumsum([len(x) + 1 for x in w])]
                for r in range(len(w) - RUN + 1):
                    a, z = int(starts[r]), int(ends[r + RUN - 1]) - Q
                    if z > a:
                        take.add(a + int(rare[a:z].argmin()))
                yield pd.DataFrame({"item_id": i, "gram": np.unique(h[sorted(take)])})

    own = _grams(items, "item_id", "passage").join(often, "gram", "left").groupBy("item_id")
    own = own.agg(F.collect_list("gram").alias("grams"), F.collect_list(F.coalesce("n", F.lit(0))).alias("counts"))  # a passage's length bounds it
    return items.join(own, "item_id").mapInPandas(run, "item_id bigint, gram bigint")


def _join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """leaks() for any number of items: documents that share a chosen q-gram with an item are verified."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).dropDuplicates(["doc_id", "key"])
    grams = _grams(docs, "key", "text")
    often = grams.join(_grams(items, "item_id", "passage").select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    chosen = through_table(chosen_grams(items, often), "p8-grams")
    near = grams.join(chosen, "gram").select("key", "item_id").distinct().join(docs, "key").join(items, "item_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [bool(Items([(0, p)]).leaked(t)) for t, p in zip(f["text"], f["passage"], strict=True)]
            yield f.loc[keep, ["doc_id", "item_id"]]

    return near.select("doc_id", "item_id", "text", "passage").mapInPandas(verify, f"doc_id {kind}, item_id bigint")


def leaks(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, item_id): documents that hold an item's passage whole, or RUN words of it.

    ``docs``: doc_id, text; ``items``: item_id, passage; other columns are ignored. Null and empty texts and
    passages match nothing; a passage shorter than Q characters can't be found; of several passages of one item
    the smallest counts. A pair may come out once for each row of docs, so repeated doc_ids may repeat it. Texts are
    searched whole. Items of at most ``block_chars`` characters are held by every task, in one scan of docs without
    shuffle; more never pass the driver and are joined by their rarest q-grams.
    """
    items = items.where("item_id is not null and passage is not null").groupBy("item_id").agg(F.min("passage").alias("passage"))
    docs = docs.select("doc_id", "text").where(F.char_length("text") >= Q)
    total = items.agg(F.sum(F.char_length("passage"))).first()[0] or 0
    if total > block_chars:
        return _join(docs, items)
    rows = [tuple(r) for r in items.collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_search(rows), f"doc_id {kind}, item_id bigint")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, split, n_docs: every item that leaked, and into how many documents."""
    found = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return read_table(spark, sf_dir, "eval_items").select("item_id", "split").dropDuplicates(["item_id"]).join(found, "item_id")


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
