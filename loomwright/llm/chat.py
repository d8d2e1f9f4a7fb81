"""What the operators on chat messages share: one spelling of roles and sessions, order, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Spellings of each role, after trimming and lower-casing; any other text is a role that can't be told.
ROLES = {
    "user": ("user", "human", "player", "customer"),
    "assistant": ("assistant", "ai", "bot", "model"),
    "system": ("system",),
}
#: Characters that show nothing: white space, controls, zero-width and bidirectional marks, fillers.
UNSEEN = r"[\s\p{Z}\p{C}\u115f\u1160\u2800\u3164\uffa0]"
#: Messages of one session are kept in pieces of this many seconds, so that no task holds a whole session.
BUCKET_SECONDS = 3600


def role_of(c: str) -> Column:
    low = F.lower(F.regexp_replace(c, UNSEEN, ""))
    out = F.lit("?")
    for role, names in ROLES.items():
        out = F.when(low.isin(*names), role).otherwise(out)
    return F.when(F.col(c).isNull(), "?").otherwise(out)


def session_key(c: str) -> Column:
    """Lower-case UUID with hyphens for any spelling of one; other ids trimmed and lower-cased; blank is null."""
    low = F.lower(F.regexp_replace(c, UNSEEN, ""))
    digits = F.regexp_replace(F.regexp_replace(low, "^urn:uuid:", ""), r"[{}()\-]", "")
    uuid = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), uuid).when(low != "", low)


def visible(c: str) -> Column:
    """Whether a text shows anything once tags, blank entities and unseen characters are gone. Null: no."""
    bare = F.regexp_replace(F.regexp_replace(c, r"<[^<>]*>", ""), r"(?i)&(nbsp|#160|#xa0|zwnj|zwj|#8203|ensp|emsp|thinsp);", "")
    return F.coalesce(F.regexp_replace(bare, UNSEEN, "") != "", F.lit(False))


def bucket_of(c: str, seconds: int = BUCKET_SECONDS) -> Column:
    return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def normalised(messages: DataFrame) -> DataFrame:
    """id, skey, role (user, assistant, system, ?), created_at, content, rag_meta; one row an id is not ensured."""
    return messages.select("id", session_key("session_id").alias("skey"), role_of("role").alias("role"), "created_at", "content", "rag_meta")


def with_previous(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Each row of ``rows`` (skey, created_at, id, ...) with ``prev_<c>`` of the row before it in its session.

    Order is created_at, then id. A session's rows are sorted in pieces of an hour; only the first and last
    row of each piece meet in the second window, so a session with a third of all rows is no single task.
    Rows without session or time have no place in the order and are left out. The first row has nulls.
    """
    rows = rows.where(F.col("skey").isNotNull() & F.col("created_at").isNotNull()).withColumn("_b", bucket_of("created_at"))
    order = [F.col("created_at").asc(), F.col("id").asc()]
    piece = Window.partitionBy("skey", "_b").orderBy(*order)
    prev = lambda w: {f"prev_{c}": F.lag(c).over(w) for c in keep}
    inner = rows.withColumns(prev(piece) | {"_n": F.row_number().over(piece), "_last": F.lead("id").over(piece).isNull()})
    edge = inner.where((F.col("_n") == 1) | F.col("_last")).drop(*[f"prev_{c}" for c in keep])
    whole = Window.partitionBy("skey").orderBy(*order)
    first = edge.withColumns(prev(whole)).where(F.col("_n") == 1)
    return inner.where(F.col("_n") > 1).unionByName(first).drop("_b", "_n", "_last")
