"""Columns of lists: missing values, membership tests, ordered removal of repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nullif_empty(c: Column | str, kind: str = "string") -> Column:
    """Null for what counts as missing: null, blank text, an empty list or map, and for numbers zero."""
    c = _c(c)
    if kind == "string":
        return F.when(F.trim(c) != "", c)
    if kind in ("array", "map"):
        return F.when(F.size(c) > 0, c)
    return F.when(c != 0, c)


def first_present(*cs: Column | str, kind: str = "string") -> Column:
    """The first value that isn't missing, in order of precedence."""
    return F.coalesce(*[nullif_empty(c, kind) for c in cs])


def has_all(c: Column | str, wanted: list[str]) -> Column:
    """Whether the list holds every wanted value; a null list holds none, an empty request is met."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), _c(c))) == 0, F.lit(not wanted))


def has_any(c: Column | str, wanted: list[str]) -> Column:
    """Whether the list holds one of the wanted values; an empty request is met."""
    return F.lit(True) if not wanted else F.coalesce(F.arrays_overlap(_c(c), F.array(*map(F.lit, wanted))), F.lit(False))


def any_contains(c: Column | str, part: str) -> Column:
    """Whether one element contains the text, case aside."""
    return F.coalesce(F.exists(_c(c), lambda x: F.lower(x).contains(part.lower())), F.lit(False))


def keep_known(c: Column | str, known: list[str]) -> Column:
    """Elements that are in a small set, case aside, in order."""
    low = F.array(*[F.lit(k.lower()) for k in known])
    return F.filter(_c(c), lambda x: F.array_contains(low, F.lower(x)))


def first_n(c: Column | str, n: int) -> Column:
    """The first n different elements that aren't null, in order of first appearance."""
    return F.slice(F.array_distinct(F.array_compact(_c(c))), 1, n)


def labels(*pairs: tuple[Column, str]) -> Column:
    """Sorted different labels whose condition holds."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in pairs]))))
