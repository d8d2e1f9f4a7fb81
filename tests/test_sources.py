import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from loomwright.sources import files as S
from loomwright.sources import http as H
from loomwright.streaming.upsert import stream_upsert


@pytest.fixture()
def server():
    tries = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            tries[self.path] = tries.get(self.path, 0) + 1
            code = 503 if self.path == "/flaky" and tries[self.path] < 3 else 404 if self.path == "/gone" else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"path": self.path}).encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http(spark, server):
    urls = [f"{server}/a", f"{server}/flaky", f"{server}/gone", "http://127.0.0.1:9/x", "nonsense"]
    got = {r["url"]: (r["status"], r["body"]) for r in H.read_urls(spark, urls, pause=0.01, retries=3, timeout=1).collect()}
    assert got[urls[0]] == (200, '{"path": "/a"}') and got[urls[1]][0] == 200 and got[urls[2]] == (404, None) and got[urls[3]] == (None, None) and got[urls[4]][1] is None
    assert H.read_urls(spark, []).count() == 0


def test_readers_bear_with_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}')
    (tmp_path / "b.json").write_text("{broken")
    assert [tuple(r) for r in S.read_json_folder(spark, str(tmp_path), "k int").collect()] == [(1, "a")]
    assert S.read_json(spark, str(tmp_path / "none.json"), "k int").count() == 0
    (tmp_path / "l.jsonl").write_text('{"k": 1}\nno\n{"k": 2}\n')
    assert S.read_json(spark, str(tmp_path / "l.jsonl"), "k int").count() == 2 and S.read_json(spark, str(tmp_path / "l.jsonl"), "k int", keep_corrupt=True).count() == 3
    (tmp_path / "m.csv").write_text("gameid,position,champion\n1,top,A\n2,team,B\n3,mid,\n")
    assert S.read_csv(spark, str(tmp_path / "m.csv"), "gameid string, position string, champion string", {"position": ["top", "mid"]}, ["champion"]).count() == 1
    (tmp_path / "t.jsonl").write_text('{"query": "q", "positive": "p"}\n')
    assert S.read_triplets(spark, str(tmp_path / "t.jsonl")).count() == 1
    (tmp_path / "c.jsonl").write_text('{"messages": "[]"}\n')
    with pytest.raises(ValueError, match="chat"):
        S.read_triplets(spark, str(tmp_path / "c.jsonl"))


def test_table(spark, tmp_path):
    t = S.Table(spark, str(tmp_path / "t"), "k int, at int, v string", ["k"], ["at"])
    assert t.read().count() == 0
    frame = lambda rows: spark.createDataFrame(rows, t.schema)
    t.upsert(frame([(1, 1, "a"), (2, 1, "b")]))
    t.upsert(frame([(1, 2, "c"), (1, 0, "old"), (3, 1, "d")]))
    assert {tuple(r) for r in t.read().collect()} == {(1, 2, "c"), (2, 1, "b"), (3, 1, "d")}
    t.update(spark.createDataFrame([(2, "new"), (3, None)], "k int, v string"), ["v"])
    t.retain(spark.createDataFrame([(2,), (3,)], "k int"))
    assert {tuple(r) for r in t.read().collect()} == {(2, 1, "new"), (3, 1, "d")}
    t.replace(frame([(9, 9, None)]))
    assert S.markdown(t.read()).split("\n")[2] == "| 9 | 9  |   |"


def test_stream(spark, tmp_path):
    for n, rows in enumerate(([(1, 1, "a")], [(1, 3, "c"), (2, 1, "x")], [(1, 2, "b")])):
        spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
    got = stream_upsert(spark, str(tmp_path / "in.parquet"), "k int, at int, v string", ["k"], ["at"], 1)
    assert {tuple(r) for r in got.collect()} == {(1, 3, "c"), (2, 1, "x")}


def test_csv_columns_by_name_among_others(spark, tmp_path):
    from loomwright.sources import files as S

    (tmp_path / "m.csv").write_text("game,extra,side,kills\ng1,x,Blue,3\ng2,y,Red,many\n,z,Red,4\n")
    rows = S.read_csv(spark, str(tmp_path / "m.csv"), "side string, game string, kills int, absent double", required=["game"])
    assert [tuple(r) for r in rows.orderBy("game").collect()] == [("Blue", "g1", 3, None), ("Red", "g2", None, None)]
