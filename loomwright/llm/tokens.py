"""p7: token ids of every text by a byte-level BPE vocabulary, by traversal of a trie with shared prefixes.

For BPE, the last token of the encoding of a word's prefix is enough to know the whole encoding: what stands
before it is the encoding of the shorter prefix. So each node of a trie of words holds one state, the last
token of the path that leads to it, and a word's ids are read by walking back from its node. A token t that is
a suffix of the path is the last one exactly if the pair (last token of the path without t, t) survives BPE as
it is. States are filled depth-first, once for each node, so words with a common prefix share its encoding.

Every Python worker has one trie, fed batch by batch; nothing is shuffled. The trie is dropped and begun anew
when it has ``max_nodes`` nodes, which bounds memory and changes no result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import read_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that splits text into words before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_NODES = 2_000_000


def byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if visible in Latin-1, else 256, 257, ..."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """ids of byte strings and the rank of each merge of two tokens, from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        names = byte_names()
        special = {k for k in model["vocab"] if any(c not in names for c in k)}
        self.id_of = {bytes(names[c] for c in k): i for k, i in model["vocab"].items() if k not in special}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # (left, right) -> (rank, merged)
        raw = lambda t: bytes(names[c] for c in t)
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = raw(a), raw(b)
            self.merge[self.id_of[a], self.id_of[b]] = (rank, self.id_of[a + b])

    def bpe(self, data: bytes) -> list[int]:
        """Plain BPE of a short byte string: again and again the best merge, the leftmost first."""
        ids = [self.id_of[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min((self.merge.get(p, (1 << 60, 0))[0] for p in zip(ids, ids[1:], strict=False)))
            if best == 1 << 60:
                break
            out, i = [], 0
            while i < len(ids):
                m = self.merge.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if m and m[0] == best:
                    out.append(m[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


class Trie:
    """Trie over bytes; node 0 is the root. ``last`` holds each node's last token, ``back`` where it began."""

    def __init__(self, vocabulary: Vocabulary, max_nodes: int = MAX_NODES) -> None:
        self.v, self.max_nodes = vocabulary, max_nodes
        self.stays: dict[tuple[int, int], bool] = {}
        self.alone = {i: vocabulary.bpe(b) == [i] for i, b in vocabulary.bytes_of.items() if len(b) <= 1}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, int], int] = {}
        self.last, self.back = [-1], [-1]
        self.stays.clear()
        self.words: dict[str, list[int]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes gives just them. a is -1 at the start of a word."""
        if (a, b) not in self.stays:
            v = self.v
            want = [b] if a < 0 else [a, b]
            self.stays[a, b] = v.bpe((b"" if a < 0 else v.bytes_of[a]) + v.bytes_of[b]) == want
        return self.stays[a, b]

    def insert(self, words: list[str]) -> None:
        """Add words in sorted order, which walks the trie depth-first: ``path`` is the branch at hand."""
        v, child, last, back, longest = self.v, self.child, self.last, self.back, self.v.longest
        for word in sorted(words):
            data, path, node = word.encode(), [0], 0
            for n in range(1, len(data) + 1):
                key = (node, data[n - 1])
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(last)
                    for size in range(min(n, longest), 0, -1):
                        t = v.id_of.get(data[n - size : n])
                        if t is not None and self.compatible(last[path[n - size]], t):
                            break
                    last.append(t)
                    back.append(path[n - size])
                path.append(node)
            ids = []
            while node:
                ids.append(last[node])
                node = back[node]
            self.words[word] = ids[::-1]

    def encode(self, texts: list[str | None], pattern: regex.Pattern) -> list[list[int]]:
        split = [pattern.findall(t) if t else [] for t in texts]
        if len(self.last) > self.max_nodes:
            self.clear()
        self.insert(list({w for ws in split for w in ws} - self.words.keys()))
        words = self.words
        return [[i for w in ws for i in words[w]] for ws in split]


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, max_nodes: int = MAX_NODES) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each row of df; other columns are dropped, rows are never merged.

    Null and empty texts have the empty list. Special tokens' strings in a text are ordinary text. Texts are
    encoded whole, whatever their length. ``vocabulary`` is the path of the file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, pattern = Trie(Vocabulary(vocabulary), max_nodes), regex.compile(PATTERN)
        for b in batches:
            for at in range(0, b.num_rows, 512):  # so that a batch of long texts isn't held as lists at once
                part = b.slice(at, 512)
                ids = trie.encode(part.column(1).to_pylist(), pattern)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of each source and language as given."""
    docs = read_table(spark, sf_dir, "documents")
    sizes = token_ids(docs.select(F.struct("source", "lang").alias("k"), "text"), "k", "text").select("k.*", F.size("ids").alias("n"))
    return sizes.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


QUERIES = {"p7_ids": p7_ids, "p7_token_counts": p7_token_counts}
