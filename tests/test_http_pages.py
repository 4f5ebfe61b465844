"""Pages as a data source, kept connections, and the progress of fetches, against a server of our own on this machine."""

import json
import subprocess
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from quaver.operators.versioned import Store
from quaver.sources import fetch as W
from quaver.sources import http_pages as H

FAST = W.Policy(timeout=5, interval=0.0, base=0.01, retries=2)


class Keeping(ThreadingHTTPServer):
    """Keeps connections open, and counts them and what is asked over each."""

    daemon_threads = True

    def __init__(self):
        self.connections: dict = {}
        outer = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def do_GET(self):
                outer.connections.setdefault(self.client_address, []).append(self.path)
                n = sum(p == self.path for c in outer.connections.values() for p in c)
                status, headers, body = 200, {}, f"page {self.path}".encode()
                if self.path == "/busy" and n < 3:
                    status = 503
                elif self.path == "/gone":
                    status = 404
                elif self.path.startswith("/round"):
                    status, headers = 307, {"Location": "/round"}
                elif self.path == "/moved":
                    status, headers = 301, {"Location": "/there?x=1#part"}
                elif self.path == "/drop":
                    self.close_connection = True  # without saying so
                elif self.path == "/last":
                    headers = {"Connection": "close"}
                self.send_response(status)
                for k, v in {**headers, "Content-Length": str(len(body))}.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server_port}"


@pytest.fixture
def server():
    s = Keeping()
    yield s
    s.shutdown()


def table(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_a_connection_is_kept(server):
    with W.Connections() as connections:
        client = W.Client(FAST, connections)
        got = [client.get(f"{server.base}/{p}") for p in ("a", "busy", "gone", "moved", "b", "drop", "c", "last", "d")]
        assert [r[1] for r in got] == [200, 200, 404, 200, 200, 200, 200, 200, 200] and got[1][4] == 3
        assert got[3][2] == "page /there?x=1"
        assert connections.opened == 3 == len(server.connections)  # anew after the dropped one and the closed one
        assert client.get(f"{server.base}/round")[3] == "ValueError: more than 10 redirects"
        assert client.get("ftp://h/x")[3].startswith("ValueError") and client.get("http://127.0.0.1:9/")[3].startswith("ConnectionRefused")
        assert client.get(f"{server.base}/ä b")[2] == "page /%C3%A4%20b"


def test_source_reads_a_partition_for_each_host(spark, server, tmp_path):
    other = Keeping()
    try:
        folder = str(tmp_path / "urls")
        asked = [f"{s.base}/{k}" for s in (server, other) for k in range(20)]
        assert H.list_urls(table(spark, [*asked, *asked, None, f"{server.base}/x\ny"]), folder) == 0
        assert H.list_urls(table(spark, asked[:5]), folder) is None
        pages = H.pages(spark, folder, FAST)
        assert pages.rdd.getNumPartitions() == 2
        got = pages.collect()
        assert sorted(r.url for r in got) == sorted(asked) and all(r.status == 200 and r.attempts == 1 for r in got)
        assert {r.url: r.body for r in got}[asked[3]] == "page /3"
        assert [len(s.connections) for s in (server, other)] == [1, 1]
        assert spark.read.format(H.NAME).option("retries", "0").load(folder).filter("status <> 200").count() == 0
    finally:
        other.shutdown()


def test_stream_takes_each_batch_once(spark, server, tmp_path):
    folder, out = str(tmp_path / "urls"), str(tmp_path / "out")

    def run():
        q = H.page_stream(spark, folder, FAST).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(90) and q.exception() is None

    H.list_urls(table(spark, [f"{server.base}/a", f"{server.base}/b"]), folder)
    run()
    assert H.list_urls(table(spark, [f"{server.base}/b", f"{server.base}/c", f"{server.base}/gone"]), folder) == 1
    run()
    run()
    got = {r.url.rpartition("/")[2]: r.error for r in spark.read.parquet(out).collect()}
    assert got == {"a": None, "b": None, "c": None, "gone": "HTTP 404"}
    assert sorted(p for c in server.connections.values() for p in c) == ["/a", "/b", "/c", "/gone"]


def test_empty_folders(spark, tmp_path):
    folder = str(tmp_path / "urls")
    assert H.pages(spark, folder).collect() == []
    assert H.list_urls(table(spark, []), folder) is None and H.batches(spark, folder) == []


def test_progress_while_it_runs(spark, tmp_path):
    """Lines are told before the end, and the finished passes are counted exactly."""

    def opener(url, policy):
        time.sleep(0.05)
        return (404, {}, b"") if url.endswith("7") else (200, {}, b"x")

    progress, told = W.Progress(spark), []
    urls = table(spark, [f"http://h{k % 40}/{k}" for k in range(120)])
    with progress.told(told.append, 0.05):
        left = W.fetch_into(urls, str(tmp_path / "got"), FAST, opener, passes=2, progress=progress)
    assert left.count() == 12
    assert (progress.asked, progress.total, progress.success, progress.failure) == (132, 132, 108, 24)
    assert (progress.done, progress.failed, progress.retries) == (132, 24, 0)
    assert len(told) > 2 and told[-1].startswith("132/132 (") and told[-1].endswith("24 failed)")
    assert any(not x.startswith("132/") for x in told)


_RETRIED = """
import json, os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from quaver.sources import fetch as W
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

def opener(url, policy):
    if url.endswith("5") and not os.path.exists({mark!r}):
        open({mark!r}, "w").close()
        raise RuntimeError("the task dies here once")
    return (503, {{}}, b"") if url.endswith("3") else (200, {{}}, b"x")

progress = W.Progress(spark)
urls = spark.createDataFrame([(f"http://h/{{k}}",) for k in range(10)], "url string")
left = W.fetch_into(urls, {out!r}, W.Policy(interval=0, base=0, retries=1), opener, passes=1, progress=progress)
print("RESULT", json.dumps([left.count(), progress.total, progress.success, progress.failure, W.answers(spark, {out!r}).count()]))
"""


def test_a_task_that_is_run_again_counts_once(tmp_path):
    code = _RETRIED.format(root=str(Path(__file__).resolve().parents[1]), mark=str(tmp_path / "mark"), out=str(tmp_path / "out"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "RESULT" in done.stdout, done.stderr[-2000:]
    assert json.loads(done.stdout.split("RESULT ")[1]) == [1, 10, 9, 1, 9]
    assert (tmp_path / "mark").exists()


def test_stored_videos_are_refreshed(spark, tmp_path):
    """Failure, fallback and success as told, and the stored records changed accordingly."""
    entry = lambda i: {"id": i, "url": "u", "title": "old", "thumbnail_url": "t", "thumbnail_urls": []}
    record = lambda niconico, youtube: json.dumps({"page_title": "p", "videos": {"niconico": [entry(i) for i in niconico], "youtube": [entry(i) for i in youtube]}})
    rows = [("a", record(["sm1", "sm2"], ["aaaaaaaaaaa"]), 2010), ("b", record([], ["zzzzzzzzzzz"]), 2011), ("c", "{", None), ("d", record(["sm1"], []), None)]
    kept = Store(spark, str(tmp_path / "s"))
    kept.rebuild({"details": (spark.createDataFrame(rows, "url string, payload_json string, published_year int"), ("url",))}, buckets=4)

    def opener(url, policy):
        if "zz" in url:
            return 404, {}, b""
        return 200, {}, b"<r><t><title>N</title></t></r>" if url.endswith("sm1") else b"<{" if "nicovideo" in url else b'{"title": "T", "thumbnail_url": "http://t"}'

    progress = W.Progress(spark)
    done, sums = W.refresh_videos(kept, "details", str(tmp_path / "m"), FAST, opener, progress=progress)
    assert sums == {"total": 4, "success": 1, "failure": 1, "fallback": 2}
    assert (progress.total, progress.success, progress.failure) == (4, 3, 1)
    assert done.counts == {"rows": 2, "updated": 4}
    got = {r.url: r.payload_json for r in kept.snapshot().table("details").collect()}
    assert json.loads(got["d"])["videos"]["niconico"][0]["title"] == "N" and json.loads(got["a"])["videos"]["youtube"][0]["thumbnail_url"] == "http://t"
    assert got["c"] == "{" and got["b"] == rows[1][1]
