"""Stores built from a wiki of our own on this machine, by the library and by the command line."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quaver.__main__ import main
from quaver.operators import search
from quaver.operators.pages import Site
from quaver.operators.versioned import Store
from quaver.sources import build as B
from quaver.sources import fetch as W

FAST = W.Policy(timeout=5, interval=0.0, base=0.01, retries=1)
LISTS = {
    "/w/list": ["?p=2", [("Alpha / ann", 1), ("Beta", 2), ("曲一覧 / x", 9)]], "/w/list?p=2": ["", [("Gamma &amp; co", 3), ("Alpha / ann", 1)]],
    "/w/tag/hall%20one": ["", [("Gamma & co", 3), ("Delta", 4)]], "/w/tag/million": ["", [("Delta", 4), ("Beta", 2)]],
}


def page(n):
    year = f"<a href='/w/tag/{2010 + n}%E5%B9%B4'>{2010 + n}年</a>"
    return f"<title>T{n} - Wiki</title>{year}<p>作曲：Kumo{n}、Umi<br>唄：Aki<h2>曲紹介</h2><p>A sentence of work {n}.</p><iframe src='https://www.youtube.com/embed/{'v' * 10}{n}'></iframe>"


@pytest.fixture
def wiki():
    broken: set[str] = set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path in LISTS and self.path not in broken:
                more, works = LISTS[self.path]
                body = f"<a href='{more}'>n</a>タグ検索" + "".join(f"<a href='/w/pages/{n}.html'>{t}</a>" for t, n in works) + "関連タグ"
            elif self.path.startswith("/w/pages/") and self.path not in broken:
                body = page(int(self.path[9:-5]))
            else:
                self.send_error(404)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", broken
    s.shutdown()


def test_build_and_refresh(spark, wiki, tmp_path, capsys):
    base, broken = wiki
    path, work = str(tmp_path / "store"), str(tmp_path / "work")
    site = {"root": base, "tag_path": "/w/tag/", "title_ending": "Wiki"}
    args = ["build", "--store", path, "--work", work, "--source-url", f"{base}/w/list", "--tag", "hall one=100", "--tag", "million=800", "--tag-base", f"{base}/w/tag/", "--site", json.dumps(site), "--request-interval", "0", "--backoff-base", "0", "--max-retries", "0"]
    broken.add("/w/pages/4.html")
    assert main(args) == 1 and Store(spark, path).numbers() == []
    assert "1 pages could not be had" in capsys.readouterr().err
    broken.clear()
    assert main(args) == 0
    out = capsys.readouterr().out
    assert "4 works listed" in out and "version 1 published" in out and "0 failed" in out
    snapshot = Store(spark, path).snapshot()
    rows = snapshot.table("songs").orderBy("sort_order").collect()
    assert [(r.raw_title, r.sort_order, r.popularity_score, r.popularity_label, r.popularity_order) for r in rows] == [
        ("Alpha / ann", 1, 0, "", 0), ("Beta", 2, 800, "million", 2), ("Gamma & co", 3, 100, "hall one", 1), ("Delta", 4, 800, "million", 1)
    ]
    assert (rows[0].title, rows[0].artist, rows[0].title_length, rows[0].song_url) == ("Alpha", "ann", 5, f"{base}/w/pages/1.html")
    told = {r.key: r.value for r in snapshot.table("metadata").collect()}
    assert (told["song_count"], told["detail_count"], told["popularity_source_tags"]) == ("4", "4", "hall one,million")
    found = search.search(B.catalog(snapshot), composer="umi").collect()
    assert [(r.title, r.artist, r.published_year) for r in found] == [("Delta", "Kumo4 / Umi", 2014), ("Beta", "Kumo2 / Umi", 2012), ("Gamma & co", "Kumo3 / Umi", 2013), ("Alpha", "Kumo1 / Umi", 2011)]
    assert main(["search", "--store", path, "--composer", "kumo3"]) == 0
    assert "Gamma & co\tKumo3 / Umi\t2013" in capsys.readouterr().out
    assert main(["dump", "--store", path, "--to", str(tmp_path / "dump")]) == 0


def test_builds_that_fail_leave_the_store(spark, wiki, tmp_path):
    base, broken = wiki
    store = Store(spark, str(tmp_path / "s"))
    site = Site(root=base, tag_path="/w/tag/")
    B.build(store, f"{base}/w/list", str(tmp_path / "w1"), (), "", site, FAST, passes=1)
    assert store.manifest().number == 1
    broken.add("/w/list")
    with pytest.raises(B.Incomplete, match="no works"):
        B.build(store, f"{base}/w/list", str(tmp_path / "w2"), (), "", site, FAST, passes=1)
    assert store.manifest().number == 1 and store.snapshot().table("songs").count() == 3


def test_options(capsys):
    for args in (["build"], ["refresh", "--store", "s", "--work", "w", "--timeout", "0"], ["refresh", "--store", "s", "--work", "w", "--request-interval", "-1"], ["build", "--store", "s", "--work", "w", "--source-url", "u", "--tag", "x"], ["search"], ["search", "--data", "d", "--store", "s"]):
        with pytest.raises(SystemExit):
            main(args)


def test_refresh_needs_a_store(spark, tmp_path, capsys):
    assert main(["refresh", "--store", str(tmp_path / "none"), "--work", str(tmp_path / "w")]) == 1
    assert "no store" in capsys.readouterr().err
