"""p6: conversations rebuilt from message rows with keyed streaming state.

The stream is keyed by shard of sessions and hour of event time, so that state of one key stays small whatever
a session's length, and one call treats many sessions. The state buffers the key's messages until the watermark
has passed the end of the hour (closing it) and the timer fires; then the messages of each session are ordered,
their faults are noted, and one segment a session and hour is emitted. Rows without ``created_at`` have a key of
their own and are emitted at the next advance of the watermark. Segments of one session are put together in
order afterwards: only their ends have to be compared.

Rows later than the watermark would be dropped by Spark; the run raises if that happened, so no result lacks
rows silently. ``lateness`` is how late rows may come between micro-batches; ``rebuild`` takes it from the files
unless it is given. Rows without time, or with one before ``FIRST``, neither move the watermark nor come too late.
"""

from __future__ import annotations

from collections.abc import Iterator
from threading import Event

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from loomwright.llm import chat
from loomwright.session import read_table, shared_dir, table_path

SCHEMA = "id bigint, session_id string, role string, content string, rag_meta string, created_at timestamp_ntz"
SEGMENT = "skey string, bucket bigint, n int, seen boolean, unknown boolean, timeless boolean, first_role string, last_role string, twice_a boolean, twice_u boolean, ids array<bigint>, roles array<string>"
COLUMNS = ["skey", "ts", "id", "code", "seen"]
NO_TIME = -(2**60)  # bucket of rows without created_at
#: Hours outside of these times are closed by the end of the stream only. Spark's watermark begins in 1970.
FIRST, LAST = "1970-01-02 00:00:00", "2110-01-01 00:00:00"
FIRST_MS, LAST_MS = (int(pd.Timestamp(x).timestamp() * 1000) for x in (FIRST, LAST))
END_OF_TIME, END = "2260-01-01 00:00:00", "!end"  # time and key of the row that closes the stream: past LAST by more than any lateness, and a time of pandas
NAMES = np.array(["user", "assistant", "?"], object)  # by code; the code of system messages is 3
#: State lives in files of the executors' disks with a copy in the checkpoint, not in their heaps.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Shards of sessions: rows of one key are that share of an hour's messages.
SHARDS = 4
FILES = 500  # files in a micro-batch at most


class _Late(StreamingQueryListener):
    """Counts the rows that a query dropped as later than the watermark, over all of its batches."""

    def __init__(self) -> None:
        self.rows, self.ended = {}, {}

    def onQueryStarted(self, event: object) -> None:
        self.ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event: object) -> None:
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self.ended.setdefault(str(event.runId), Event()).set()

    def of(self, query: object) -> int:
        """Rows dropped by an ended query; waits until all of its events are here."""
        if not self.ended.setdefault(str(query.runId), Event()).wait(60):
            raise RuntimeError("the end of the query was not reported")
        return self.rows.get(str(query.runId), 0)


def segments_in(rows: pd.DataFrame, bucket: int) -> pd.DataFrame:
    """One row (SEGMENT) a session for the messages of a bucket; repeated ids count once, system messages not."""
    rows = rows[rows["code"] != 3].drop_duplicates(["skey", "id"]).sort_values(["skey", "ts", "id"], kind="stable")
    if rows.empty:
        return pd.DataFrame()
    key, code, ids, seen = (rows[c].to_numpy() for c in ("skey", "code", "id", "seen"))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    last = np.r_[first[1:], len(key)] - 1
    follows = np.r_[key[1:] == key[:-1], False]
    after = np.r_[code[1:], 0]
    some = lambda x: np.add.reduceat(x.astype("int64"), first) > 0
    names = NAMES[code]
    return pd.DataFrame({
        "skey": key[first], "bucket": bucket, "n": (last - first + 1).astype("int32"), "seen": some(seen), "unknown": some(code == 2), "timeless": bucket == NO_TIME,
        "first_role": names[first], "last_role": names[last],
        "twice_a": some(follows & (code == 1) & (after == 1)), "twice_u": some(follows & (code == 0) & (after != 1)),
        "ids": [ids[a : b + 1] for a, b in zip(first, last, strict=True)], "roles": [names[a : b + 1] for a, b in zip(first, last, strict=True)],
    })


def _pack(f: pd.DataFrame) -> bytes:
    t = pa.Table.from_pandas(f[COLUMNS], preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpack(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_pandas()


def _advance(seconds: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = int(key[1])
        if state.hasTimedOut:
            (held,) = state.get
            state.remove()
            out = segments_in(pd.concat([_unpack(x) for x in held]), bucket)
            if len(out):
                yield out
            return
        held = list(state.get[0]) if state.exists else []
        held += [_pack(f[f["skey"] != END]) for f in frames]
        state.update((held,))
        closes = (bucket + 1) * seconds * 1000
        if bucket == NO_TIME:
            closes = 0
        elif bucket * seconds * 1000 < FIRST_MS or closes > LAST_MS:
            closes = LAST_MS + 1
        state.setTimeoutTimestamp(max(closes, state.getCurrentWatermarkMs() + 1))

    return step


def _at() -> Column:
    """Event time of a row; null: it has none that a watermark can follow."""
    at = F.col("created_at").cast("timestamp")
    return F.when(at >= F.lit(FIRST).cast("timestamp"), F.least(at, F.lit(LAST).cast("timestamp")))


def segments_of(stream: DataFrame, lateness: str = "30 days", seconds: int = chat.BUCKET_SECONDS, shards: int = SHARDS) -> DataFrame:
    """Streaming: message rows (id, session_id, role, content, created_at) -> segments.

    Rows without session are left out. Null roles can't be told; null contents show nothing; a null
    created_at makes the segment ``timeless``; rows with a null id count as one row.
    """
    code = F.element_at(F.create_map(*[F.lit(x) for kv in {"user": 0, "assistant": 1, "?": 2, "system": 3}.items() for x in kv]), chat.role_of("role"))
    rows = stream.select(
        F.when(F.col("session_id") == END, F.col("created_at").cast("timestamp")).otherwise(_at()).alias("at"),
        F.when(F.col("session_id") == END, END).otherwise(chat.session_key("session_id")).alias("skey"),
        F.coalesce("id", F.lit(-1)).alias("id"),
        code.alias("code"),
        chat.visible("content").alias("seen"),
        F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)).alias("ts"),
        F.coalesce(chat.bucket_of("created_at", seconds), F.lit(NO_TIME)).alias("bucket"),
    ).withColumn("shard", F.pmod(F.xxhash64("skey"), F.lit(shards)))
    rows = rows.withWatermark("at", lateness).where("skey is not null")
    return rows.groupBy("shard", "bucket").applyInPandasWithState(_advance(seconds), SEGMENT, "held array<binary>", "append", GroupStateTimeout.EventTimeTimeout)


def lateness_of(messages: DataFrame) -> str:
    """How late rows of the files come at most, in the order in which a stream reads these: by their times of change.

    Files changed at the same time may be read in any order. One row a file is compared.
    """
    ends = messages.select(_at().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"))
    ends = ends.groupBy("file", "changed").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    so_far = F.max("high").over(Window.orderBy("changed").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    late = ends.select("low", so_far.alias("high")).agg(F.max(F.unix_seconds("high") - F.unix_seconds("low"))).first()[0]
    return f"{(late or 0) + 1} seconds"


def rebuild(spark: SparkSession, path: str, lateness: str | None = None, max_files_per_trigger: int = FILES) -> DataFrame:
    """All segments of the message files below ``path``, read as a stream to its end.

    ``lateness`` is that of the files unless it is given; rows later than one given are an error. A second run from
    the same checkpoint brings one row of a far time, which closes all keys still open.
    """
    out, state, end = shared_dir(spark, "segments"), shared_dir(spark, "segments-state"), shared_dir(spark, "segments-end")
    spark.createDataFrame([], SCHEMA).write.parquet(end)
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    lateness = lateness or lateness_of(spark.read.schema(SCHEMA).parquet(path + "*"))
    provider, late = "spark.sql.streaming.stateStore.providerClass", _Late()
    before = spark.conf.get(provider)

    def run() -> None:
        stream = reader.parquet(path + "*").unionByName(spark.readStream.schema(SCHEMA).parquet(end))
        query = segments_of(stream, lateness).writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out)
        query.awaitTermination()
        if lost := late.of(query):
            raise ValueError(f"{lost} rows came later than {lateness}; give a longer lateness")

    spark.conf.set(provider, STORE)
    spark.streams.addListener(late)
    try:
        run()
        spark.sql(f"select cast(null as bigint) id, '{END}' session_id, cast(null as string) role, cast(null as string) content, cast(null as string) rag_meta, timestamp_ntz'{END_OF_TIME}' created_at").write.mode("append").parquet(end)
        run()
    finally:
        spark.streams.removeListener(late)
        spark.conf.set(provider, before)
    return spark.read.schema(SEGMENT).parquet(out)


def sessions_of(segments: DataFrame) -> DataFrame:
    """skey, n, seen, broken, unanswered of each session, from its segments in order.

    Only ends of neighbouring segments are compared; a session has at most as many segments as hours.
    """
    w = Window.partitionBy("skey").orderBy("bucket")
    s = segments.where("n > 0 and not timeless").withColumns({"before": F.lag("last_role").over(w), "after": F.lead("first_role").over(w)})
    s = s.select(
        "skey", "n", "seen", "unknown", F.lit(False).alias("timeless"),
        (F.col("twice_a") | ((F.col("first_role") == "assistant") & F.coalesce(F.col("before") != "user", F.lit(True)))).alias("wrong_a"),
        (F.col("twice_u") | ((F.col("last_role") == "user") & F.coalesce(F.col("after") != "assistant", F.lit(True)))).alias("open_u"),
    ).unionByName(segments.where("timeless or n = 0").select("skey", "n", "seen", "unknown", "timeless", F.lit(False).alias("wrong_a"), F.lit(False).alias("open_u")))
    return s.groupBy("skey").agg(
        F.sum("n").alias("n"), F.bool_or("seen").alias("seen"),
        F.bool_or(F.col("unknown") | F.col("timeless") | F.col("wrong_a")).alias("broken"), F.bool_or("open_u").alias("unanswered"),
    )


def verdicts(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """session_id, skey, fault (null: kept) of all sessions; ``known`` is the table of sessions.

    Repeated rows of ``known`` count once; where spellings of one session differ there, the smallest is used.
    """
    k = known.select(chat.session_key("session_id").alias("skey"), "session_id").where("skey is not null").groupBy("skey").agg(F.min("session_id").alias("session_id"))
    all_ = sessions.join(k, "skey", "full")
    fault = F.when(F.col("n").isNull() | ~F.col("seen"), "empty").when(F.col("session_id").isNull() | F.col("broken"), "broken").when(F.col("unanswered"), "unanswered")
    return all_.select(F.coalesce("session_id", "skey").alias("session_id"), "skey", fault.alias("fault"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = rebuild(spark, table_path(sf_dir, "lol_chat_messages")).drop("ids", "roles")
    return verdicts(sessions_of(segments), read_table(spark, sf_dir, "lol_chat_sessions")).where("fault is not null").select("session_id", "fault")


def p6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, turn (from 0), id, role, content of every conversation that is kept, one row a message."""
    segments = rebuild(spark, table_path(sf_dir, "lol_chat_messages"))
    kept = verdicts(sessions_of(segments), read_table(spark, sf_dir, "lol_chat_sessions")).where("fault is null").drop("fault")
    w = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    turns = (
        segments.where("n > 0").withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .join(kept, "skey").select("session_id", "base", F.posexplode(F.arrays_zip("ids", "roles")).alias("k", "m"))
        .select("session_id", (F.col("base") + F.col("k")).cast("int").alias("turn"), F.col("m.ids").alias("id"), F.col("m.roles").alias("role"))
    )
    texts = read_table(spark, sf_dir, "lol_chat_messages").select("id", "content").groupBy("id").agg(F.max("content").alias("content"))
    return turns.join(texts, "id").select("session_id", "turn", "id", "role", "content")


#: p6_found in SQL: whole sessions in windows.
FOUND_SQL = r"""WITH k AS (SELECT DISTINCT id, created_at, regexp_replace(lower(session_id), '[\s\p{Z}\p{C}]', '', 'g') AS low, regexp_replace(lower(coalesce(role, '')), '[\s\p{Z}\p{C}]', '', 'g') AS r,
  coalesce(regexp_replace(regexp_replace(regexp_replace(content, '<[^<>]*>', '', 'g'), '&nbsp;', '', 'g'), '[\s\p{Z}\p{C}]', '', 'g'), '') <> '' AS seen FROM lol_chat_messages),
h AS (SELECT *, regexp_replace(low, '[{}()-]', '', 'g') AS x FROM k WHERE low <> ''),
m AS (SELECT id, created_at, seen, CASE WHEN regexp_matches(x, '^[0-9a-f]{32}$') THEN x[1:8] || '-' || x[9:12] || '-' || x[13:16] || '-' || x[17:20] || '-' || x[21:32] ELSE low END AS skey,
  CASE WHEN r IN ('user', 'human', 'player', 'customer') THEN 'u' WHEN r IN ('assistant', 'ai', 'bot', 'model') THEN 'a' WHEN r = 'system' THEN 's' ELSE '?' END AS r FROM h),
o AS (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after FROM m WHERE r <> 's' WINDOW w AS (PARTITION BY skey ORDER BY created_at, id)),
g AS (SELECT skey, bool_or(seen) AS seen, bool_or(r = '?' OR created_at IS NULL OR (r = 'a' AND coalesce(before, '') <> 'u')) AS broken, bool_or(r = 'u' AND coalesce(after, '') <> 'a') AS unanswered FROM o GROUP BY skey),
s AS (SELECT DISTINCT session_id FROM lol_chat_sessions),
v AS (SELECT coalesce(s.session_id, g.skey) AS session_id, CASE WHEN g.skey IS NULL OR NOT g.seen THEN 'empty' WHEN s.session_id IS NULL OR g.broken THEN 'broken' WHEN g.unanswered THEN 'unanswered' END AS fault FROM g FULL JOIN s ON s.session_id = g.skey)
SELECT session_id, fault FROM v WHERE fault IS NOT NULL"""

ORACLES = {"p6_found": FOUND_SQL}
QUERIES = {"p6_found": p6_found, "p6_conversations": p6_conversations}
