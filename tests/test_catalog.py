"""Every query with a SQL twin against DuckDB, and literal vectors of the text and parameter rules."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quaver import catalog_queries as Q
from quaver.functions import text as X
from quaver.operators import checks, corpus, search, stats, store
from quaver.plans import params
from quaver.sources import catalog as C

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = Q.queries()[name](spark, DATA)
    wanted = con.execute(Q.oracle_sql()[name])
    names = [x[0] for x in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, wanted.fetchall())


@pytest.mark.parametrize("text, n", [("がぎく", 3), ("心️", 1), ("二人👨‍👩‍👧", 3), ("A B　C\tD", 4), ("A​B⁠C﻿", 3), ("A⠀B", 2), ("", 0)])
def test_title_length(spark, text, n):
    df = spark.createDataFrame([(text,)], "t string").select(X.title_length(X.nfc("t")).alias("n"))
    assert df.first().n == n


@pytest.mark.parametrize("text, parts", [("a", ("a", "", "")), (" a ", (" a ", "", "")), ("a / b", ("a", "b", "")), ("a/b/c/d", ("a", "b", "c/d"))])
def test_title_parts(spark, text, parts):
    r = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in X.title_parts(F.col("t")).items()]).first()
    assert tuple(r) == parts


def test_names_and_lines(spark):
    r = spark.createDataFrame([(" ＡｂC ß ", " a　 b \n\n c")], "a string, b string").select(X.credit_name("a").alias("x"), X.clean_text(F.col("b")).alias("y"), X.useful_lines(F.col("b")).alias("z")).first()
    assert (r.x, r.y, r.z) == ("abc ss", "a b c", ["a b", "c"])


@pytest.mark.parametrize("query, message", [({"sort": ["x"]}, "sort is not supported"), ({"length": ["abc"]}, "length must be an integer"), ({"length": ["-1"]}, "length must be an integer"), ({"page": ["0"]}, "page must be 1 or greater"), ({"popularity_label": ["no"]}, "popularity_label is not supported")])
def test_bad_parameters(query, message):
    with pytest.raises(ValueError, match=message):
        params.parse(query, {"PROMO"})


def test_paging():
    assert params.paging(0, 1, 50) == {"total_pages": 1, "start": 0, "end": 0}
    assert params.paging(120, 3, 50) == {"total_pages": 3, "start": 101, "end": 120}
    assert params.parse({"page": ["3"]}).offset == 100


def test_plans(spark):
    c = C.catalog(spark, DATA)
    assert C.catalog(spark, DATA).songs.inputFiles() == c.songs.inputFiles()  # built once
    plan = search.matching(c, composer="x")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert "TakeOrderedAndProject" in search.search(c)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="unsupported sort order: x"):
        search.order("x")


def test_upsert_and_children(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("b", 2, "z"), ("b", 3, "w"), ("c", 1, "q")], "k string, v int, t string")
    assert sorted(tuple(r) for r in store.upsert(old, new, "k", "v").collect()) == [("a", 1, "x"), ("b", 3, "w"), ("c", 1, "q")]
    statements = [r[0] for r in store.inserts(spark.createDataFrame([("it's", None)], "a string, b int"), "t").collect()]
    assert statements == ['INSERT INTO "t" ("a", "b") VALUES (\'it\'\'s\', NULL);']
    tied = spark.createDataFrame([("b", 2, "z"), ("b", 2, "y")], old.schema)
    assert {tuple(r) for k in (1, 2) for r in store.upsert(old.limit(0), tied.orderBy("t" if k > 1 else F.desc("t")), "k", "v").collect()} == {("b", 2, "z")}
    with pytest.raises(ValueError, match="metadata lacks b, c"):
        store.dump({"metadata": spark.createDataFrame([("a", "1")], "key string, value string")}, metadata="metadata", required=("c", "a", "b"))


def test_readiness(spark):
    counts = spark.createDataFrame([(2, 2)], "songs long, details long")
    m = spark.createDataFrame([("a", "1"), ("song_count", "2"), ("detail_count", "x")], "key string, value string")
    assert checks.readiness(counts, m, ("a",)).first().ready
    assert not checks.readiness(counts, m, ("a", "b")).first().ready
    assert not checks.readiness(counts, m, ("a",), match_counts=True).first().ready


def test_addresses_and_pages(spark):
    ips = spark.createDataFrame([("8.8.8.8",), ("10.0.0.1",), ("300.1.1.1",), ("172.20.0.1",)], "v string").filter(checks.public_ip(F.col("v"))).collect()
    assert [r.v for r in ips] == ["8.8.8.8"]
    r = spark.createDataFrame([("https://h/x?p=1&q=2", "<a href='?p=3'>")], "u string, h string").select(corpus.page_urls(F.col("u"), corpus.last_page(F.col("h"))).alias("x")).first()
    assert r.x == ["https://h/x?p=1&q=2", "https://h/x?q=2&p=2", "https://h/x?q=2&p=3"]


def test_title_length_property(spark):
    """The columns against the rule itself, on texts made to be awkward."""
    import random

    import regex

    parts = ["a", "e\u0301", "か\u3099", " ", "\u3000", "\r\n", "\n", "\u0301", "\u200b", "\u200c", "\u2060", "\ufeff", "\u2800", "\U0001f468", "\U0001f1ef\U0001f1f5", "각", "\x01", "\x1c"]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)]
    counted = lambda c: not c.isspace() and not set(c) <= set(X.BLANKS)
    wanted = [sum(map(counted, regex.findall(r"\X", t))) for t in texts]
    got = [r.n for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.title_length(F.col("t")).alias("n")).orderBy("k").collect()]
    assert got == wanted


def test_numbered_within_buckets(spark):
    rows = spark.range(100).selectExpr("id % 3 as g", "id % 7 as b", "id")
    got = {r.id: (r.x, r.y) for r in stats.numbered(stats.numbered(rows, "x", ["g"], ["b"], "id"), "y", [], ["b"], "id").collect()}
    for i, (x, y) in got.items():
        before = [k for k in range(100) if (k % 7, k) <= (i % 7, i)]
        assert (x, y) == (sum(k % 3 == i % 3 for k in before), len(before))


def test_criteria():
    known = ("殿堂入り", "A", "B", "C")
    p = params.SearchParams(length=7, composer="x", year=2010, labels=("A", "B"), sort="title_length_desc")
    assert params.criteria(p, known, known[1:], True) == ["統計から適用", "7文字", "作曲者: x", "公開年: 2010", "根拠タグ: 2件", "文字数降順"]
    assert params.criteria(params.SearchParams(labels=known[1:]), known, known[1:]) == ["人気度順"]
    assert [params.label_summary(x, known) for x in ((), known, known[1:], known[:2], known[:3])] == ["根拠タグ: 指定なし", "全タグ", "殿堂入り除外", "根拠タグ: 殿堂入り / A", "根拠タグ: 3件"]


@pytest.mark.parametrize("raw, how, value", [("3", {}, 3), ("0", {"least": 1}, None), ("x", {}, None), ("-1", {}, None), ("0.5", {"kind": float, "more": True}, 0.5), ("0", {"kind": float, "more": True}, None), ("nan", {"kind": float}, None)])
def test_numbers_of_command_lines(raw, how, value):
    if value is not None:
        assert params.number(raw, **how) == value
    else:
        with pytest.raises(ValueError, match="must be"):
            params.number(raw, **how)


def test_drill_down_and_profile(spark):
    c = C.catalog(spark, DATA)
    labels = tuple(k for k, v in C.LABELS if v)
    for dimension, key, table in (("length", "title_length", c.songs), ("year", "published_year", c.details)):
        for r in stats.buckets(table, key).limit(2).collect():
            n = search.total(c, **search.drill_down(dimension, r[key], ())).first().total
            assert n == r.n
    assert search.drill_down("label", "PROMO", labels) == {"length": None, "labels": ("PROMO",), "composer": "", "year": None}
    with pytest.raises(ValueError, match="no such dimension"):
        search.drill_down("x", 1, labels)
    requests = search.representative(c, "https://catalog.example.test/pages/42.html", "supplier", "PROMO", 1997)
    assert len(requests) == 9
    assert [x[0] for x in stats.profile({k: requests[k] for k in ("health", "song_detail")}, 1)] == ["health", "song_detail"]


def test_command_line(spark, capsys):
    from quaver.__main__ import main

    assert main(["search", "--data", DATA, "--length", "8", "--page-size", "50"]) == 0
    assert capsys.readouterr().out.splitlines()[0].startswith("8文字")
    assert main(["stats", "--data", DATA]) == 0 and main(["report", "--data", DATA, "--limit", "1"]) == 0
    with pytest.raises(SystemExit):
        main(["search", "--data", DATA, "--length", "x"])
