"""Chunks of entities, intents of questions, rewritten queries, token budgets and chat history."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions.text import CUT, squeeze, token_estimate, truncate_tokens
from loomwright.operators.rules import first_match

#: Intents by patterns over the lower-case question; the first that matches counts.
INTENTS = [
    ("COMPARISON", r"^compare\b|\bstronger\b|\bor\b.*\bfor the\b"),
    ("COUNTER", r"\bcounters?\b|\bbeat\b|\bagainst\b|\blosing to\b"),
    ("SYNERGY", r"\bduo\b|\bpartner\b|\bpairs? well\b"),
    ("BUILD", r"\bitems?\b.*\bbuy\b|\bbuild\b|\bstack with\b"),
    ("LORE", r"\blore\b|\borigin\b|\bcome from\b"),
    ("SKILL_INFO", r"\bcooldown\b|\bpassive\b|\bwhat does\b"),
    ("ITEM", r"\bgold\b|\bprice of\b"),
]
#: Tokens that an answer may have, by intent; others have 512.
BUDGETS = {"ITEM": 256, "LORE": 512, "COMPARISON": 768, "COUNTER": 768}


def chunk(df: DataFrame, key: str, entity: str, kinds: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """chunk_id, entity_name, chunk_type, text: one row for each kind whose text isn't blank.

    ``kinds``: type -> (text, condition or None). White space of the texts is squeezed.
    """
    parts = []
    for kind, (text, condition) in kinds.items():
        d = df if condition is None else df.where(condition)
        parts.append(d.select(F.concat_ws(":", F.col(key).cast("string"), F.lit(kind)).alias("chunk_id"), F.col(entity).alias("entity_name"), F.lit(kind).alias("chunk_type"), squeeze(text).alias("text")))
    return reduce(DataFrame.unionByName, parts).where("text != ''")


def intent(c: Column | str, rules: list[tuple[str, str]] | None = None) -> Column:
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return first_match([(k, low.rlike(p)) for k, p in rules or INTENTS], "UNKNOWN")


def answer_budget(kind: Column, most: int = 768) -> Column:
    return F.least(F.lit(most), F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in BUDGETS.items()], F.lit(512)))


def rewrite_query(kind: Column, entity: Column, question: Column) -> Column:
    """Search text for an intent: a template with the entity, or the question where there is no entity."""
    templates = {"COUNTER": "%s counters weak against", "BUILD": "%s build core items", "LORE": "%s lore story region", "SKILL_INFO": "%s ability cooldown", "SYNERGY": "%s synergy duo partners"}
    made = F.coalesce(*[F.when(kind == k, F.format_string(v, entity)) for k, v in templates.items()], F.concat_ws(" ", entity, F.lower(kind)))
    return F.when(F.coalesce(entity, F.lit("")) != "", made).otherwise(question)


def dispatch(df: DataFrame, kind: str, handlers: dict[str, Callable[[DataFrame], DataFrame]], default: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each handler gets the rows of its intent, the default all others; results are put together."""
    parts = [h(df.where(F.col(kind) == k)) for k, h in handlers.items()]
    rest = default(df.where(~F.coalesce(F.col(kind).isin(*handlers), F.lit(False))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, rest])


#: Spellings of each role, after lower-casing and without white space.
ROLES = {"user": ("user", "human", "player", "customer"), "assistant": ("assistant", "ai", "bot", "model"), "system": ("system",)}
UNSEEN = r"[\s\p{Z}\p{C}]"


def session_key(c: str) -> Column:
    """Lower-case UUID with hyphens for any spelling of one; other ids lower-cased without white space; blank is null."""
    low = F.lower(F.regexp_replace(c, UNSEEN, ""))
    digits = F.regexp_replace(low, r"[{}()\-]", "")
    uuid = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), uuid).when(low != "", low)


def normalised_messages(messages: DataFrame) -> DataFrame:
    """id, session_id, role (user, assistant, system, ?), content, created_at: one row an id, sessions and roles in one spelling.

    Rows without id or session are left out.
    """
    low = F.lower(F.regexp_replace(F.coalesce("role", F.lit("")), UNSEEN, ""))
    role = F.coalesce(*[F.when(low.isin(*names), k) for k, names in ROLES.items()], F.lit("?"))
    rows = messages.where("id is not null").dropDuplicates(["id"])
    return rows.select("id", session_key("session_id").alias("session_id"), role.alias("role"), "content", "created_at").where("session_id is not null")


def format_history(messages: DataFrame, key: str, role: str, text: str, order: list[Column], last: int = 4, budget: int = 256) -> DataFrame:
    """key, history: the last messages in order, each cut to its share of the budget; blank ones give no line.

    The share is the budget by one more than the messages there are, ``last`` at most.
    """
    rows = messages.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= last)
    rows = rows.withColumn("_all", F.count("*").over(Window.partitionBy(key)))
    rows = rows.withColumn("_t", F.trim(F.coalesce(text, F.lit("")))).where("_t != ''")
    share = F.greatest(F.lit(1), F.floor(F.lit(budget) / (F.col("_all") + 1))).cast("int")
    line = F.concat_ws(": ", F.col(role), truncate_tokens("_t", share, "..."))
    one = rows.select(key, F.col("_n"), line.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "line"))).alias("a"))
    return one.select(key, F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("history"))


def fit_context(context: Column | str, window: int, answer: int, fixed: Column | str, mark: str = CUT) -> Column:
    """The context cut to the tokens left: at most 2048, the window less answer, history (256) and fixed parts."""
    room = F.least(F.lit(2048), F.lit(window - answer - 256) - token_estimate(fixed)).cast("int")
    return truncate_tokens(context, room, mark)


def sessions(session: DataFrame, message: DataFrame, at_least: int = 1) -> DataFrame:
    """session_id, n_messages, last_at of sessions with that many messages; messages without session don't count."""
    n = message.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("created_at").alias("last_at"))
    return session.select("session_id").distinct().join(n, "session_id", "left").select("session_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "last_at").where(F.col("n_messages") >= at_least)


def without_messages(session: DataFrame, message: DataFrame) -> DataFrame:
    """Sessions that no message names; null names match nothing."""
    return session.join(message.select("session_id").where("session_id is not null"), "session_id", "left_anti")
