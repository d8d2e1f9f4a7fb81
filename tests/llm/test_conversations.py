import datetime as dt

import pytest

from loomwright.llm import chat
from loomwright.llm import conversations as C

T0 = dt.datetime(2024, 5, 1, 10, 0)
A, B = "0f0f7a31-5c2e-4b7d-9a10-00c0ffee0001", "9681e6e1-10a9-4ed3-a241-448e7bb39ea2"


def row(i, session, role, content, minutes):
    return (i, session, role, content, None, None if minutes is None else T0 + dt.timedelta(minutes=minutes))


def write(spark, tmp_path, batches):
    path = str(tmp_path / "lol_chat_messages.parquet")
    for rows in batches:
        spark.createDataFrame(rows, C.SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def faults(spark, segments, sessions):
    known = spark.createDataFrame([(s,) for s in sessions], "session_id string")
    return {r["session_id"]: r["fault"] for r in C.verdicts(C.sessions_of(segments), known).collect()}


def test_faults(spark, tmp_path):
    rows = [
        row(1, A, "user", "q", 0), row(2, A.upper(), "ai", "a", 1), row(3, A, "system", None, 2), row(3, A, "system", None, 2),
        row(4, B, "human", "q", 0), row(5, "{" + B + "}", "assistant ", "a", 70), row(6, B.replace("-", ""), "assistant", "a", 200),
        row(7, "c", "user", "q", 0), row(8, "c", "user", "q", 1), row(9, "c", "bot", "a", 2),
        row(10, "d", "user", " ​", 0), row(11, "d", "model", "<p></p>", 1),
        row(12, "e", "user", "q", None), row(13, "f", "?", "q", 1), row(14, None, "user", "q", 1), row(15, "g", "user", "x" * 100_000, 0), row(16, "g", "model", "y", 0),
        row(17, "h", "user", "q", 0), row(18, "h", "ai", "a", 1),
    ]
    got = faults(spark, C.rebuild(spark, write(spark, tmp_path, [rows])), [A, B, "c", "d", "e", "f", "g", "i", "i"])
    assert got == {A: None, B: "broken", "c": "unanswered", "d": "empty", "e": "broken", "f": "broken", "g": None, "h": "broken", "i": "empty"}


def test_rows_late_by_days_join_their_hour(spark, tmp_path):
    day = 24 * 60
    batches = [[row(1, A, "user", "q", 0), row(9, B, "user", "q", 9 * day)], [row(2, A, "ai", "a", 1), row(8, B, "ai", "a", 9 * day + 1)], [row(3, A, "user", "q", 2), row(4, A, "ai", "a", 3)]]
    segments = C.rebuild(spark, write(spark, tmp_path, batches), "20 days", max_files_per_trigger=1)
    assert faults(spark, segments, [A, B]) == {A: None, B: None}
    assert {r["skey"]: r["ids"] for r in segments.collect()} == {A: [1, 2, 3, 4], B: [9, 8]}


def test_rows_later_than_agreed_are_no_silent_loss(spark, tmp_path):
    day = 24 * 60
    batches = [[row(1, A, "user", "q", 100 * day)], [row(2, A, "ai", "a", 100 * day + 1)], [row(3, B, "user", "q", 0)]]
    with pytest.raises(ValueError, match="later"):
        C.rebuild(spark, write(spark, tmp_path, batches), "1 day", max_files_per_trigger=1)


def test_rows_without_time_close_no_other_hours(spark, tmp_path):
    """Two and three micro-batches, the first with a row without time; rows come up to 200 days late."""
    day = 24 * 60
    first = [row(1, A, "user", "q", 0), row(2, "n", "user", "q", None), row(3, B, "user", "q", 200 * day), row(4, B, "ai", "a", 200 * day + 1)]
    second, third = [row(5, A, "ai", "a", 1), row(6, "c", "user", "q", 0)], [row(7, "d", "user", "q", 5), row(8, "c", "ai", "a", 1), row(9, "n", "ai", "a", None)]
    for n, batches in enumerate([[first, second], [first, second, third]]):
        segments = C.rebuild(spark, write(spark, tmp_path / str(n), batches), max_files_per_trigger=1)
        want = {A: None, B: None, "n": "broken", "c": "unanswered"} | ({"c": None, "d": "unanswered"} if n else {})
        assert faults(spark, segments, [A, B, "n", "c", *"d"[: n]]) == want


def test_times_out_of_range_are_kept(spark, tmp_path):
    at = lambda i, s, role, *t: (i, s, role, "x", None, dt.datetime(*t))
    batches = [
        [at(1, A, "user", 2024, 1, 1), at(3, "old", "user", 1950, 1, 1), at(5, "far", "user", 9998, 1, 1)],
        [at(2, A, "ai", 2024, 1, 2), at(4, "old", "ai", 1950, 1, 1, 0, 1)],
        [at(7, "zero", "user", 1970, 1, 1), at(6, "far", "ai", 9998, 1, 1, 0, 1)],
        [at(8, "zero", "ai", 1970, 1, 1, 0, 5), at(9, "old", "user", 1950, 1, 1, 0, 2), at(10, "one", "user", 2100, 1, 1)],
    ]
    segments = C.rebuild(spark, write(spark, tmp_path, batches), max_files_per_trigger=1)
    assert faults(spark, segments, [A, "old", "far", "zero", "one"]) == {A: None, "old": "unanswered", "far": None, "zero": None, "one": "unanswered"}


def test_empty_table(spark, tmp_path):
    assert faults(spark, C.rebuild(spark, write(spark, tmp_path, [[]])), [A]) == {A: "empty"}


def test_previous_row_over_hours(spark):
    rows = [(1, "s", T0, "a", "clash"), (2, "s", T0 + dt.timedelta(hours=5), "b", "clash"), (3, "s", T0 + dt.timedelta(hours=5), "c", "clash"), (4, None, T0, "d", "x"), (5, "s", None, "e", "x")]
    df = spark.createDataFrame(rows, "id bigint, skey string, created_at timestamp_ntz, content string, other string")
    assert {r["id"]: r["prev_content"] for r in chat.with_previous(df, ["content"]).collect()} == {1: None, 2: "a", 3: "b"}
