"""Queries on streams and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.plans.base import Registry, Tables
from loomwright.session import table_path
from loomwright.streaming.upsert import stream_upsert as run

query = Registry()
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1")
def stream_upsert(t: Tables):
    return run(t.spark, table_path(t.sf_dir, "events"), EVENTS, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(t: Tables):
    return t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))
