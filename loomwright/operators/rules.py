"""Rules as data: labelled patterns and conditions compiled to one projection.

A rule table is a list of (label, condition). Nothing here calls Python for a row; the patterns are evaluated
by the JVM in one pass over the text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Effects that take control from a champion, and the words for them in descriptions.
CONTROL = [
    ("stun", r"\bstun(s|ned|ning)?\b"), ("root", r"\broot(s|ed|ing)?\b"), ("slow", r"\bslow(s|ed|ing)?\b"), ("silence", r"\bsilenc(e|es|ed|ing)\b"),
    ("taunt", r"\btaunt(s|ed|ing)?\b"), ("fear", r"\bfear(s|ed|ing)?\b"), ("charm", r"\bcharm(s|ed|ing)?\b"), ("knock-up", r"\bknock(s|ed|ing)?[- ]?up\b"),
    ("grounding", r"\bground(ing|ed|s)?\b"),
]
HARD = ["stun", "root", "silence", "taunt", "fear", "charm", "knock-up"]
SOFT = ["slow", "grounding"]


def tag(c: Column | str, rules: Iterable[tuple[str, str]]) -> Column:
    """Labels whose pattern occurs in the lower-case text, sorted; an empty list for null."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(low.rlike(p), F.lit(False)), F.lit(k)) for k, p in rules])))


def tag_except(c: Column | str, rules: Iterable[tuple[str, str, str | None]], upto: str | None = None) -> Column:
    """As ``tag`` with exclusions: (label, pattern, pattern that forbids it). ``upto``: what follows it isn't read."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    if upto:
        low = F.get(F.split(low, upto, 2), F.lit(0))
    holds = lambda p: F.coalesce(low.rlike(p), F.lit(False))
    return F.array_sort(F.array_compact(F.array(*[F.when(holds(p) & ~(holds(x) if x else F.lit(False)), F.lit(k)) for k, p, x in rules])))


def contains_flags(c: Column | str, words: Iterable[str]) -> Column:
    """Words that occur anywhere in the lower-case text, in the order given."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.array_compact(F.array(*[F.when(F.coalesce(F.contains(low, F.lit(w)), F.lit(False)), F.lit(w)) for w in words]))


def classify(df: DataFrame, rules: list[tuple[str, str]], into: str = "label") -> DataFrame:
    """A row for every label whose SQL condition holds; rows without any give none."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(e), F.lit(False)), F.lit(k)) for k, e in rules]))
    return df.withColumn(into, F.explode(found))


def first_match(rules: list[tuple[str, Column]], default: str | None = None) -> Column:
    """The label of the first condition that holds."""
    out = F.lit(default)
    for label, condition in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def score(rules: list[tuple[Column, float, str]], most_reasons: int = 2) -> tuple[Column, Column]:
    """Sum of the scores of all conditions that hold, and the first reasons joined by '; '."""
    holds = [F.coalesce(c, F.lit(False)) for c, _, _ in rules]
    total = sum((F.when(h, F.lit(s)).otherwise(0.0) for h, (_, s, _) in zip(holds, rules, strict=True)), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(h, F.lit(r)) for h, (_, _, r) in zip(holds, rules, strict=True)]))
    return total, F.array_join(F.slice(reasons, 1, most_reasons), "; ")
