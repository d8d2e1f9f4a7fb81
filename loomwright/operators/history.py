"""Chat history in tables: sessions, messages and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.serving import sessions
from loomwright.sources.files import Table

SESSION = "session_id string, title string, created_at timestamp_ntz, updated_at timestamp_ntz"
MESSAGE = "id bigint, session_id string, role string, content string, rag_meta string, created_at timestamp_ntz"
MOST_TITLE = 250


class History:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.session = Table(spark, f"{path}/sessions", SESSION, ["session_id"], ["updated_at"])
        self.message = Table(spark, f"{path}/messages", MESSAGE, ["id"], ["created_at"])

    def add(self, messages: DataFrame) -> None:
        """New messages; sessions not seen before are made, the others' ``updated_at`` moves on."""
        self.message.upsert(messages.select("id", "session_id", "role", "content", "rag_meta", "created_at"))
        touched = messages.where("session_id is not null").groupBy("session_id").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
        old = self.session.read()
        rows = touched.join(old, "session_id", "left").select("session_id", "title", F.coalesce("created_at", "first").alias("created_at"), F.greatest("updated_at", "last").alias("updated_at"))
        self.session.upsert(rows)

    def rename(self, session_id: str, title: str) -> None:
        spark = self.session.spark
        self.session.update(spark.createDataFrame([(session_id, title[:MOST_TITLE])], "session_id string, title string"), ["title"])

    def delete(self, session_id: str) -> None:
        """The session and its messages."""
        self.session.replace(self.session.read().where(F.col("session_id") != session_id))
        self.message.replace(self.message.read().where(F.coalesce(F.col("session_id") != session_id, F.lit(True))))

    def drop_empty(self) -> None:
        """Sessions without messages go."""
        self.session.retain(self.message.read().select("session_id").where("session_id is not null"))

    def listed(self, at_least: int = 0) -> DataFrame:
        return sessions(self.session.read(), self.message.read(), at_least)
