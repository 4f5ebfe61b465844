"""Scans of text against small files."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from quaver.functions import text as X
from quaver.operators import checks
from quaver.operators import scans as S


def test_domains(spark):
    text = "see https://real.site/x, http://a.example.com:80/ and http://localhost\nHOSTS = 'x.org,localhost,y.example.com' http://${V}.net/\nhttp://real.site:8080"
    got = S.domains(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), settings=("HOSTS",)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, "real.site"), (1, 2, "x.org"), (1, 3, "real.site:8080")]


def test_link_failures(spark):
    docs = [
        ("index.md", "# Top\n[a](a.md#one-two) [b](./b.md) [x](gone.md) [y](a.md#nine) [w](https://x.y/z.md) ![i](no.md) [u](../up.md) [s](<a.md>)"),
        ("a.md", "## One `two` #\n```\n# One two\n```\n# 見出し、あ!\n[h](a.md#見出しあ)"), ("b.md", "# B\n# b\n"), ("c.md", None),
    ]
    got = S.link_failures(spark.createDataFrame(docs, "name string, text string")).collect()
    assert sorted(tuple(r) for r in got) == [("b.md", "repeated heading", "b"), ("c.md", "no link here", ""), ("index.md", "missing file", "gone.md"), ("index.md", "missing heading", "a.md#nine")]


def test_documents_out_of_reach(spark):
    """Circles, a tail behind one, and chains; against a plain walk."""
    rng = random.Random(1)
    names = [f"n{k}.md" for k in range(60)] + ["index.md"]
    links = {n: [names[rng.randrange(61)] for _ in range(rng.choice([0, 1, 1, 2]))] for n in names}
    links |= {"x.md": ["y.md"], "y.md": ["z.md"], "z.md": ["x.md", "tail.md"], "tail.md": [], "self.md": ["self.md"], "chain.md": [], "index.md": ["n0.md", "n1.md"], "n0.md": ["chain.md"]}
    docs = spark.createDataFrame([(n, "# T\n" + " ".join(f"[l]({t})" for t in own)) for n, own in links.items()], "name string, text string")
    steps, todo = {"index.md": 0}, ["index.md"]
    for n in todo:
        for t in links[n]:
            if t not in steps:
                steps[t] = steps[n] + 1
                todo.append(t)
    assert {r.name: r.steps for r in S.reached(docs, ("index.md",)).collect()} == {n: steps.get(n) for n in links}
    linked = {t for n, own in links.items() for t in own if t != n}
    got = {r.name for r in S.lost(docs, ("index.md",)).collect()}
    assert got == {n for n in links if n not in steps and n in linked} and {"x.md", "y.md", "z.md", "tail.md"} <= got and "self.md" not in got
    assert S.lost(docs.limit(0)).collect() == []


@pytest.mark.parametrize("value, shown", [
    ("a@b.1", None), ("a@b.co", "a@b.co"), ("x a.b+c@d-e.f.org.", "a.b+c@d-e.f.org"), ("a@EXAMPLE.COM", "a@EXAMPLE.COM"), ("a@example.com", None), ("a@b.c", None), ("éa@b.de", None), ("é.a@b.de", ".a@b.de"), ("a@b.deü", None), ("a@b.c1.de_x", None), ("-a@b.de", "a@b.de"),
])
def test_emails(spark, value, shown):
    """As Python's own expression finds them."""
    plain = re.findall(r"\b[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", value)
    assert [x for x in plain if not x.endswith("@example.com")] == ([shown] if shown else [])
    got = checks.emails(spark.createDataFrame([(1, f"first\n{value}"), (2, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == ([(1, 2, shown)] if shown else [])


def test_public_addresses(spark):
    """Against the classes of the standard library, at the edges of every network and some random places."""
    rng = random.Random(3)
    edges = [n + d for first, size in checks.SPECIAL for n in (first, first + (1 << (32 - size))) for d in (-1, 0, 1)]
    numbers = [n % 2**32 for n in edges] + [rng.randrange(2**32) for _ in range(300)] + [ipaddress.IPv4Address(x) for x in ("192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.0.170", "100.64.0.1", "198.51.100.1")]
    texts = [str(ipaddress.IPv4Address(n)) for n in numbers] + ["8.8.8.08", "08.8.8.8", "256.1.1.1", "8.8.8.0", "0.8.8.8", "8.00.8.8"]

    def public(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return False
        return not (a.is_private or a.is_loopback or a.is_reserved or a.is_unspecified or a.is_multicast)

    rows = spark.createDataFrame([(x,) for x in texts], "v string").select("v", checks.public_ip(F.col("v")).alias("p")).collect()
    assert {r.v: r.p for r in rows} == {x: public(x) for x in texts}


def test_folding(spark):
    values = ["TWITTER", "ſite HTTP", "hﬅtp", "ﬀ", "Straße", "ẞ", "X.COM", "公式サイト", "İnstagram", "ŉ", "ẖttp"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", X.folded(F.col("v")).alias("f")).collect()
    assert {r.v: r.f for r in rows} == {v: v.casefold() for v in values}


@pytest.mark.parametrize("url, part, whole", [("https://w.test/pages/1.html", True, True), ("https://w.test/pages/1.html?x", True, False), ("http://w.test/pages/1.html", False, False), ("https://w.test/pages/a.html", False, False), ("https://v.test/pages/1.html", False, False), ("", False, False)])
def test_page_url(spark, url, part, whole):
    r = spark.createDataFrame([(url,)], "u string").select(S.page_url(F.col("u"), "w.test").alias("part"), S.page_url(F.col("u"), "w.test", whole=True).alias("whole")).first()
    assert (r.part, r.whole) == (part, whole)


def test_small_rules(spark):
    files = spark.createDataFrame([("a/b.py",), ("a/.git/c.py",), ("d.png",), ("e",)], "p string")
    assert [r.p for r in files.filter(S.scanned(F.col("p"), (".py", ".md"), (".git",))).collect()] == ["a/b.py"]
    songs = spark.createDataFrame([("x",), ("stop",)], "title string")
    assert S.works(songs, ("stop",)).count() == 1 and S.works(songs, ()).count() == 2
    assert S.default_labels({"a": 3, "b": 2, "c": 1}) == ("a", "b")
    assert spark.createDataFrame([("Été  2/3_x-あ！",)], "t string").select(X.slug(F.col("t"))).first()[0] == "été-23_x-あ"


def test_secret_assignments(spark):
    text = "\n".join([
        "password=9855ae4fa49702326c", "github_token: ghp_abcdefgh1234", "PASSWD = 'Your-dummy.Example1'", 'cloudflare_api_token="abcdefghijkl', "private-key : a/b+c=d:e_f-g.h", "token=short", "my_token=abcdefghijkl",
        "token=replace-with-abcdefgh", "secret=example-abcdefgh", "api_key='abcdefghijkl' token='mnopqrstuvwx'",
    ])
    got = checks.secret_assignments(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(1, "9855ae4fa49702326c"), (2, "ghp_abcdefgh1234"), (3, "Your-dummy.Example1"), (4, "abcdefghijkl"), (5, "a/b+c=d:e_f-g.h"), (10, "abcdefghijkl")]
