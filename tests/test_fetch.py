"""Fetching against a server of our own on this machine."""

import threading
import time
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quaver.operators import pages, store
from quaver.sources import fetch as W

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def server():
    """Answers by path; counts how often each path was asked for."""
    asked: dict[str, list[float]] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.setdefault(self.path, []).append(time.monotonic())
            n = len(asked[self.path])
            status, headers, body = 200, {}, f"page {self.path}".encode()
            if self.path == "/busy":
                status, headers = (503, {"Retry-After": "0"}) if n < 3 else (200, {})
            elif self.path == "/always":
                status = 503
            elif self.path == "/gone":
                status = 404
            elif self.path == "/moved":
                status, headers = 302, {"Location": "/there"}
            elif self.path == "/latin":
                headers, body = {"Content-Type": "text/html; charset=ISO-8859-1"}, "é".encode("latin-1")
            elif self.path == "/bad":
                body = b"a\xffb"
            elif self.path == "/later" and n == 1:
                status = 404
            elif self.path.startswith("/tag/"):
                page = int(self.path.partition("p=")[2] or 1)
                name = self.path[5:].partition("?")[0]
                status = 404 if name == "broken" and page == 2 else 200
                body = f"<a href='?p=2'>2</a>タグ検索<a href='/w/pages/{page}.html'>{name} {page}</a><a href='/w/pages/9.html'>both / {page // 9}</a><a href='/w/pages/8.html'>曲一覧 / x</a>関連タグ".encode()
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


FAST = W.Policy(timeout=5, interval=0.02, base=0.01, retries=2)


def test_answers(spark, server):
    base, asked = server
    urls = spark.createDataFrame([(f"{base}/{p}",) for p in ("a", "a", "busy", "always", "gone", "moved", "latin", "bad")] + [(None,), ("http://127.0.0.1:9/x",), ("no url",)], "url string")
    got = {r.url.rpartition("/")[2]: r for r in W.fetched(urls, FAST).collect()}
    assert (got["a"].body, got["a"].attempts, len(asked["/a"])) == ("page /a", 1, 1)
    assert (got["busy"].status, got["busy"].attempts) == (200, 3)
    assert (got["always"].error, got["always"].attempts) == ("HTTP 503", 3) and (got["gone"].error, got["gone"].attempts) == ("HTTP 404", 1)
    assert got["moved"].body == "page /there" and got["latin"].body == "é" and got["bad"].body == "a�b"
    assert got["x"].body is None and got["x"].error and got["no url"].error and len(got) == 9


@pytest.mark.parametrize("value, seconds", [("7", 7.0), (" 0 ", 0.0), ("Mon, 01 Jan 2024 00:00:30 GMT", 30.0), ("Sun, 31 Dec 2023 23:00:00 GMT", 0.0), ("Mon, 01 Jan 2024 00:00:05 -0000", 5.0), ("soon", None), ("-3", None), ("", None), (None, None)])
def test_asked_wait(value, seconds):
    assert W.asked_wait(value, NOW) == seconds


def test_waits_between_attempts():
    slept, answers = [], [(503, {}, b""), (429, {"Retry-After": "99"}, b""), (502, {"Retry-After": "3"}, b""), (504, {}, b""), (200, {}, b"x")]
    client = W.Client(W.Policy(interval=0, retries=4), lambda url, policy: answers.pop(0), slept.append, lambda: 0.0)
    assert client.get("http://h/") == ("http://h/", 200, "x", None, 5)
    assert [x for x in slept if x] == [2.0, 30.0, 3.0, 16.0]


def test_hosts_are_paced():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append((round(now[0], 3), round(seconds, 3)))
        now[0] += seconds

    client = W.Client(W.Policy(interval=0.5), lambda url, policy: (200, {}, b""), sleep, lambda: now[0])
    for url, passed in (("http://a/1", 0.1), ("http://b/1", 0.1), ("http://a/2", 1.0), ("http://a/3", 0.0), ("http://b/2", 0.0)):
        client.get(url)
        now[0] += passed
    assert [x for x in slept if x[1]] == [(0.2, 0.3)]


def test_resumed(spark, server, tmp_path):
    base, asked = server
    path = str(tmp_path / "got")
    urls = spark.createDataFrame([(f"{base}/{p}",) for p in ("a", "b", "later", "gone")], "url string")
    left = W.fetch_into(urls, path, FAST, passes=1, commits=2)
    assert sorted(r.url.rpartition("/")[2] for r in left.collect()) == ["gone", "later"]
    left = W.fetch_into(urls, path, FAST)
    assert [r.url for r in left.collect()] == [f"{base}/gone"]
    assert len(asked["/a"]) == 1 and len(asked["/later"]) == 2 and len(asked["/gone"]) == 4
    assert W.answers(spark, path).count() == 3 and W.answers(spark, path + "-none").count() == 0


def test_tags(spark, server, tmp_path):
    base, asked = server
    tags = spark.createDataFrame([("one", 0, 1200, f"{base}/tag/one"), ("broken", 1, 1000, f"{base}/tag/broken"), ("two", 2, 900, f"{base}/tag/two")], "tag string, tag_rank int, score int, url string")
    got = sorted(tuple(r) for r in W.tag_hits(tags, str(tmp_path / "tags"), pages.Site(root="https://w.test/"), FAST).collect())
    assert got == [
        ("both / 0", "one", 0, 1200, 2, "https://w.test/w/pages/9.html"), ("both / 0", "two", 2, 900, 2, "https://w.test/w/pages/9.html"),
        ("one 1", "one", 0, 1200, 1, "https://w.test/w/pages/1.html"), ("one 2", "one", 0, 1200, 3, "https://w.test/w/pages/2.html"),
        ("two 1", "two", 2, 900, 1, "https://w.test/w/pages/1.html"), ("two 2", "two", 2, 900, 3, "https://w.test/w/pages/2.html"),
    ]


def test_video_metadata(spark, tmp_path):
    def opener(url, policy):
        return (404, {}, b"") if "zz" in url else (200, {}, b'{"title": "T"}' if "oembed" in url else b"<x><title>N</title></x>")

    ids = spark.createDataFrame([("youtube", "abcdefghi_k"), ("youtube", "zzzzzzzzzzz"), ("niconico", "sm9"), ("niconico", "sm9")], "service string, id string")
    got = sorted(tuple(r) for r in W.video_metadata(ids, str(tmp_path / "m"), FAST, opener).collect())
    assert got == [("niconico", "sm9", "N", "https://nicovideo.cdn.nimg.jp/thumbnails/9/9.L"), ("youtube", "abcdefghi_k", "T", "https://img.youtube.com/vi/abcdefghi_k/mqdefault.jpg")]
