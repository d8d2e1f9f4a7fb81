"""Columns of maps: renamed and dropped keys, values that aren't defaults, first values of nested lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rename_keys(c: Column | str, names: dict[str, str]) -> Column:
    """Keys by their new names; keys without one keep theirs. Where two become one, the last entry stays."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    new = lambda k: F.coalesce(F.try_element_at(table, k), k)
    entries = F.transform(F.map_entries(_c(c)), lambda e: F.struct(new(e["key"]).alias("key"), e["value"].alias("value")))
    kept = F.aggregate(entries, F.slice(entries, 1, 0), lambda a, e: F.concat(F.filter(a, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(kept)


def drop_values(c: Column | str, *values: float) -> Column:
    """Entries whose value is neither null nor one of ``values``."""
    return F.map_filter(_c(c), lambda _, v: v.isNotNull() & ~v.isin(*values))


def with_prefix(c: Column | str, prefix: str) -> Column:
    return F.map_filter(_c(c), lambda k, _: F.startswith(k, F.lit(prefix)))


def overlaid(base: Column | str, over: Column | str) -> Column:
    """Both maps; where a key is in both, the value of ``over`` unless it is null."""
    b, o = F.coalesce(_c(base), _c(over)), F.coalesce(_c(over), _c(base))
    return F.map_zip_with(b, o, lambda _, x, y: F.coalesce(y, x))


def first_values(modifiers: Column | str) -> Column:
    """``values`` of the first of a list of modifiers; null where there is none."""
    return F.get(_c(modifiers), F.lit(0))["values"]
