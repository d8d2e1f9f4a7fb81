"""Columns of text: cleaning, keys, sizes in tokens, tuples and JSON inside text."""

from __future__ import annotations

import html as html_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TAG = "<[^>]+>"
#: Truncated texts end with this.
CUT = "..."


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def clean_html(c: Column | str) -> Column:
    """Tags as spaces, white space squeezed."""
    return squeeze(F.regexp_replace(_c(c), TAG, " "))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Named and numbered entities as characters."""
    return s.map(lambda x: None if x is None else html_.unescape(x))


def clean_html_paragraphs(c: Column | str) -> Column:
    """Paragraph tags part paragraphs, breaks part lines, other tags go; each paragraph is squeezed."""
    t = F.regexp_replace(_c(c), r"(?i)</?p(\s[^>]*)?>", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", "\n"), TAG, " ")
    lines = F.transform(F.split(t, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[ \t]+", " "), r" ?\n ?", "\n")))
    return F.array_join(F.filter(lines, lambda p: p != ""), "\n\n")


def drop_block(c: Column | str, tag: str) -> Column:
    """The text without a tag's whole element, case aside, over lines."""
    return F.regexp_replace(_c(c), rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")


def resolve_tokens(c: Column | str, known: dict[str, str] | None = None) -> Column:
    """Placeholders @name@ and {{name}}: known ones replaced, the others removed."""
    t = _c(c)
    for k, v in (known or {}).items():
        t = F.replace(F.replace(t, F.lit(f"@{k}@"), F.lit(v)), F.lit("{{" + k + "}}"), F.lit(v))
    return squeeze(F.regexp_replace(F.regexp_replace(t, r"\{\{[^}]*\}\}", ""), r"@[A-Za-z0-9_.*]+@", ""))


def normalize_key(c: Column | str) -> Column:
    """Lower-case key without space and the marks '._-:,&/."""
    return F.regexp_replace(F.lower(F.trim(_c(c))), r"[\s'._\-:,&/]", "")


def slug(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "[^a-zA-Z0-9]", "")


def capitalize(c: Column | str) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.substring(_c(c), 1, 1)), F.lower(F.substring(_c(c), 2, 2**30)))


def word_count(c: Column | str) -> Column:
    """Words between white space; 0 for blank and null texts."""
    t = squeeze(c)
    return F.coalesce(F.when(t == "", 0).otherwise(F.size(F.split(t, " "))), F.lit(0))


def acronym(c: Column | str) -> Column:
    """First letters of the words, lower case."""
    return F.lower(F.array_join(F.transform(F.split(squeeze(c), " "), lambda w: F.substring(w, 1, 1)), ""))


def aliases(c: Column | str) -> Column:
    """Keys under which a name is found: itself, first and last word, acronym; the first of equal ones stays."""
    words = F.split(squeeze(c), " ")
    several = F.size(words) > 1
    out = F.array(normalize_key(c), F.when(several, normalize_key(F.get(words, F.lit(0)))), F.when(several, normalize_key(F.element_at(words, -1))), F.when(several, acronym(c)))
    return F.array_distinct(F.array_compact(out))


def token_estimate(c: Column | str) -> Column:
    """Estimated tokens: UTF-8 bytes by three, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.octet_length(_c(c)) / 3.0), F.lit(0)).cast("bigint")


def truncate_tokens(c: Column | str, budget: int | Column, mark: str = CUT) -> Column:
    """The longest start of the text that, trimmed and with the mark, stays within the budget of tokens.

    Texts within the budget are unchanged. The mark takes its own estimated tokens; where that leaves nothing it is
    left out. A budget of 0 or less gives an empty text, null stays null. The size is in bytes, so the start is found
    by adding up characters.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    own = -(-len(mark.encode()) // 3)
    marked = budget > own
    room = F.when(marked, budget - own).otherwise(budget) * 3
    t = _c(c)
    fit = F.aggregate(
        F.split(t, ""), F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full")),
        lambda a, ch: F.when(a["full"] | (a["used"] + F.octet_length(ch) > room), F.struct(a["used"].alias("used"), a["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct((a["used"] + F.octet_length(ch)).alias("used"), (a["n"] + 1).alias("n"), F.lit(False).alias("full"))),
        lambda a: a["n"],
    )
    wide = F.octet_length(t) > F.length(t)
    kept = F.when(wide, fit).otherwise(F.greatest(F.lit(0), room).cast("int"))
    cut = F.concat(F.rtrim(F.substring(t, F.lit(1), kept)), F.when(marked, mark).otherwise(""))
    return F.when(budget <= 0, F.when(t.isNotNull(), "")).when(token_estimate(t) <= budget, t).otherwise(cut)


def utc_iso(c: Column | str) -> Column:
    """A time as ISO 8601 text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(_c(c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_in_text(c: Column | str) -> Column:
    """The first {...} of a text, fences left out; null where there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(_c(c), r"```(?:json)?", ""), r"(?s)\{.*\}", 0), F.lit(""))


def tuples_in_text(c: Column | str, patterns: dict[str, str]) -> Column:
    """array<struct>: the n-th matches of several patterns side by side."""
    return F.arrays_zip(*[F.regexp_extract_all(_c(c), F.lit(p), F.lit(1)).alias(k) for k, p in patterns.items()])


def script_bodies(c: Column | str) -> Column:
    """Bodies of all script elements of a page."""
    return F.regexp_extract_all(_c(c), F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))


def rewrite(c: Column | str, steps: list[tuple[str, str]]) -> Column:
    """Regular replacements one after the other, as for frequent misspellings."""
    t = _c(c)
    for pattern, by in steps:
        t = F.regexp_replace(t, pattern, by)
    return t
