"""p3: oversized texts cut into pieces at natural boundaries, content-defined.

Cut points c1 < c2 < ... satisfy c(k+1) - c(k) <= max_chars - overlap_chars; piece k runs from c(k) minus the
overlap to c(k+1), so no piece is longer than max_chars and neighbours share exactly overlap_chars. Within the
reach of the next cut, a rolling hash over the last characters picks a landmark (its largest value), and the cut
snaps to the nearest boundary of the most natural kind there is: end of a paragraph, of a sentence or line, of
a word, any character. Hash and boundaries depend on the text nearby only, so an edit alters its own piece and
its neighbours, after which the cuts fall together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import read_table

KINDS = ("paragraph", "sentence", "word", "none")
BLANK = regex.compile(r"(?:\r\n|[\n\r\u2028\u2029])[^\S\n\r]*(?:(?:\r\n|[\n\r\u2028\u2029])[^\S\n\r]*)+|\u2029")
#: End of a sentence: closing marks and space after .!? and the like; full-width marks need no space. Or end of a line.
STOP = regex.compile(r"[.!?…]+[\"'”’»)\]]*(?P<gap>\s+)|[。！？]+[”’」』）]*(?P<gap>\s*)|(?P<gap>[\n\r\u2028\u2029]\s*)")
SPACE = regex.compile(r"\s+")
WIDTH, BASE = 16, 0x9E3779B97F4A7C15  # characters in the rolling hash, its multiplier


def _cuts(text: str, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what lies between two units."""
    spans = [m.span("gap") if "gap" in pattern.groupindex else m.span() for m in pattern.finditer(text)]
    a = np.array(spans, "int64").reshape(-1, 2)
    return a[:, 0], a[:, 1]


def _longest(n: int, starts: np.ndarray, ends: np.ndarray) -> int:
    return int((np.r_[starts, n] - np.r_[0, ends]).max())


def boundaries(text: str) -> list[np.ndarray]:
    """For each kind but the last: the sorted gaps as array (2, n) of starts and ends; kinds include those before."""
    para, stop, space = (_cuts(text, p) for p in (BLANK, STOP, SPACE))
    both = sorted({*zip(*map(np.ndarray.tolist, para), strict=True), *zip(*map(np.ndarray.tolist, stop), strict=True)})
    mix = np.array(both, "int64").reshape(-1, 2)
    mix[:, 1] = np.maximum.accumulate(mix[:, 1]) if len(mix) else mix[:, 1]
    return [np.array(para), mix.T, np.array(space)]


def kind_of(text: str, gaps: list[np.ndarray], reach: int) -> int:
    """Index in KINDS of the first kind all of whose units fit into ``reach`` characters."""
    return next((k for k, g in enumerate(gaps) if _longest(len(text), *g) <= reach), 3)


def landmarks(text: str) -> np.ndarray:
    """Rolling hash of the WIDTH characters before each position 0..n."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("uint64")
    h = np.zeros(len(codes) + 1, "uint64")
    for k in range(min(WIDTH, len(codes))):
        h[k + 1 :] += (codes[: len(codes) - k] + np.uint64(1)) * np.uint64(pow(BASE, k, 1 << 64))
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _within(gap: np.ndarray, n: int) -> np.ndarray:
    """All positions from the start to the end of any gap: a cut there parts no unit."""
    edge = np.zeros(n + 2, "int64")
    np.add.at(edge, gap[0], 1)
    np.add.at(edge, gap[1] + 1, -1)
    return np.flatnonzero(edge.cumsum()[: n + 1])


def split(text: str, most: int, overlap: int) -> tuple[str, list[tuple[int, int, str]]]:
    """Kind of the text and its pieces (start, end, kind of the cut at its end; '' at the text's end)."""
    overlap = max(0, min(overlap, most - 1))
    reach, n = most - overlap, len(text)
    gaps = boundaries(text)
    kind, marks = kind_of(text, gaps, reach), landmarks(text)
    spots = [_within(g, n) for g in gaps]
    out, cut, least = [], 0, max(1, reach // 2)
    while n - cut > reach:
        low, high = cut + least, cut + reach
        mark = low + int(marks[low : high + 1].argmax())
        for k in range(4):
            if k == 3:
                end = mark
                break
            at = lambda a: spots[k][np.searchsorted(spots[k], a) : np.searchsorted(spots[k], high, "right")]  # noqa: B023, E731
            near = at(low)
            if not len(near) and k >= kind:
                near = at(cut + 1)
            if len(near):
                end = int(near[np.abs(near - mark).argmin()])
                break
        out.append((max(0, cut - overlap) if out else 0, end, KINDS[k]))
        cut = end
    out.append((max(0, cut - overlap) if out else 0, n, ""))
    return KINDS[kind], out


def with_limits(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id, text, max_chars, overlap_chars: limits by trimmed lower-case type, else those of ``default``."""
    own = F.lower(F.trim(F.regexp_replace("chunk_type", r"[\s\p{Z}]+", " ")))
    known = limits.select(F.col("chunk_type").alias("known"))
    c = chunks.select("chunk_id", "text", own.alias("own")).join(known, F.col("own") == F.col("known"), "left")
    return c.withColumn("key", F.coalesce("known", F.lit("default"))).join(limits.select(F.col("chunk_type").alias("key"), "max_chars", "overlap_chars"), "key").select("chunk_id", "text", "max_chars", "overlap_chars")


PIECE = "chunk_id string, piece int, start int, cut string, boundary string, text string"


def pieces(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id, piece (from 0), start, cut, boundary, text: the pieces of every text longer than its limit.

    ``cut`` is the kind of boundary at the piece's end, empty for the last; ``boundary`` the kind of the whole
    text. Rows with the same chunk_id are one record: they give the same pieces, which callers make distinct.
    Null texts and texts within their limit give no rows; neither do types without limit where no ``default``
    is given. A limit under 1 counts as 1, an overlap as at most one less than the limit.
    """
    long = with_limits(chunks, limits).withColumn("max_chars", F.greatest("max_chars", F.lit(1))).where(F.char_length("text") > F.col("max_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk_id", pa.string()), ("piece", pa.int32()), ("start", pa.int32()), ("cut", pa.string()), ("boundary", pa.string()), ("text", pa.string())])
        for b in batches:
            rows = []
            for i, text, most, overlap in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                kind, parts = split(text, most, overlap or 0)
                rows += [(i, n, a, cut, kind, text[a:z]) for n, (a, z, cut) in enumerate(parts)]
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return long.mapInArrow(run, PIECE)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(read_table(spark, sf_dir, "document_chunks").dropDuplicates(["chunk_id"]), read_table(spark, sf_dir, "chunk_limits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(read_table(spark, sf_dir, "document_chunks"), read_table(spark, sf_dir, "chunk_limits")).where("piece = 0").select("chunk_id", "boundary").distinct()


#: p3_found in SQL: the longest unit of each kind. chr(1) marks where sentences end.
FOUND_SQL = r"""WITH l AS (SELECT chunk_type AS k, max_chars AS m, overlap_chars AS o FROM chunk_limits), c AS (SELECT DISTINCT chunk_id, text, lower(trim(chunk_type, ' ')) AS k FROM document_chunks WHERE text IS NOT NULL),
j AS (SELECT chunk_id, replace(text, chr(13), '') AS t, length(text) AS n, coalesce(a.m, d.m) AS m, coalesce(a.m - a.o, d.m - d.o) AS r FROM c LEFT JOIN l a ON a.k = c.k CROSS JOIN (SELECT * FROM l WHERE k = 'default') d),
u AS (SELECT chunk_id, r, list_max(list_transform(string_split_regex(t, '\n[ \t]*\n\s*'), lambda x: length(x))) AS p,
  list_max(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(t, '([.!?…])[ \t]+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: length(x))) AS s,
  list_max(list_transform(string_split_regex(t, '\s+'), lambda x: length(x))) AS w FROM j WHERE n > m)
SELECT chunk_id, CASE WHEN p <= r THEN 'paragraph' WHEN s <= r THEN 'sentence' WHEN w <= r THEN 'word' ELSE 'none' END AS boundary FROM u"""

ORACLES = {"p3_found": FOUND_SQL}
QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
