"""What the query modules share: table access and a registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.session import read_table


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        """Register a function of Tables under its own name; ``sql`` computes the same in ANSI SQL."""

        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def r4(x: str, n: int = 4) -> str:
    """SQL of functions.numeric.digits."""
    return f"(floor(({x}) * {float(10**n)} + 0.5) / {float(10**n)})"


#: Messages in SQL, one row an id, roles and sessions in one spelling: m(id, content, created_at, skey, role).
BARE = r"regexp_replace(lower(coalesce({}, '')), '[\s\p{{Z}}\p{{C}}]', '', 'g')"
CHAT = f"""k AS (SELECT DISTINCT id, content, created_at, {BARE.format('session_id')} AS low, {BARE.format('role')} AS r FROM lol_chat_messages WHERE id IS NOT NULL),
h AS (SELECT *, regexp_replace(low, '[{{}}()-]', '', 'g') AS x FROM k),
m AS (SELECT id, content, created_at, CASE WHEN regexp_matches(x, '^[0-9a-f]{{32}}$') THEN x[1:8] || '-' || x[9:12] || '-' || x[13:16] || '-' || x[17:20] || '-' || x[21:32] ELSE low END AS skey,
  CASE WHEN r IN ('user', 'human', 'player', 'customer') THEN 'user' WHEN r IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' WHEN r = 'system' THEN 'system' ELSE '?' END AS role FROM h WHERE low <> '')"""
