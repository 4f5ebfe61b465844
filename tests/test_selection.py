"""Medians by brackets, places of pages, and the trigram index, each against the plain way."""

import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from quaver.operators import search, selection, trigrams
from quaver.sources import catalog as C

DATA = "/root/testdata/sf0.001"


def plan_of(spark, make):
    """The physical plan, with all filters of its scans."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("few", [3, 100_000])
def test_medians(spark, few):
    rng = random.Random(few)
    groups = {
        "even": [rng.gauss(0, 1e6) for _ in range(5000)],
        "odd": [rng.random() for _ in range(4001)],
        "ties": [1.0] * 3000 + [2.0] * 3000,
        "most": [5.0] * 4000 + [rng.random() for _ in range(100)],
        "between": [0.0] * 2000 + [rng.random() for _ in range(4)] + [1.0] * 2000,
        "skew": [10.0 ** rng.randrange(-300, 300) for _ in range(3001)],
        "one": [7.5], "two": [1.0, 4.0], None: [3.0, 9.0, -1.0], "same": [2.0] * 50,
    }
    rows = [(k, v) for k, own in groups.items() for v in own] + [("none", None), ("one", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r.g: r.median for r in selection.medians(df, "g", "x", few).collect()}
    assert got == {k: median(v) for k, v in groups.items()}
    assert selection.medians(df.limit(0), "g", "x").collect() == []


@pytest.mark.parametrize("sort", ["popularity", "published_year_asc"])
def test_pages_by_places(spark, sort):
    plain, stored = C.catalog(spark, DATA), C.placed(spark, DATA, sort)
    assert sort not in plain.places
    every = search.search(plain, sort, None).collect()
    for limit, offset in ((25, 0), (50, 90), (10, 195), (10, 500), (1, 199)):
        page = search.search(stored, sort, limit, offset)
        assert page.collect() == every[offset : offset + limit]
    plan = plan_of(spark, lambda: search.page(*stored.places[sort], 10, 100))
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan) and "GreaterThanOrEqual(place,101)" in plan
    filtered = search.search(stored, sort, 5, 2, length=9)
    assert filtered.collect() == search.search(plain, sort, 5, 2, length=9).collect()


@pytest.mark.parametrize("sort", ["popularity", "title_length_asc", "title_length_desc", "published_year_asc", "published_year_desc"])
def test_far_pages_by_counts(spark, sort):
    c = C.catalog(spark, DATA)
    every = [r.song_url for r in search.matching(c).orderBy(*search.order(sort)).collect()]
    for offset, limit, step in ((0, 10, 7), (33, 50, 7), (190, 50, 1000), (500, 5, 7)):
        got = search.far_page(search.matching(c), sort, limit, offset, step)
        assert [r.song_url for r in got.collect()] == every[offset : offset + limit]


def test_trigram_index(spark, tmp_path):
    rng = random.Random(2)
    names = ["".join(rng.choices("abcé𝒳 ", k=rng.randrange(0, 9))) for _ in range(200)] + ["aaa", "aaaa", "ab%c_", "x.*y"]
    people = spark.createDataFrame([(f"u{k % 60}", "composer", n, n) for k, n in enumerate(names)] + [("u9", "vocalist", "zzz", "zzz"), ("u8", "composer", None, None)], "song_url string, role string, name string, normalized_name string")
    path = str(tmp_path / "index")
    trigrams.build(people, path)
    for wanted in ("abc", "aaa", "a", "é", "𝒳", "b%c", ".*y", "bca", "abcabc", "zzz", "  ", "aaaa", "nothing like it"):
        plain = {r.song_url for r in people.filter((F.col("role") == "composer") & F.contains("normalized_name", F.lit(wanted))).collect()}
        assert {r.song_url for r in trigrams.songs_of(spark, path, wanted).collect()} == plain, wanted
    plan = plan_of(spark, lambda: trigrams.songs_of(spark, path, "abca"))
    scans = re.findall(r"FileScan parquet \[(.*?)\].*?Location.*?/(postings|credits)\b.*?PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert {s[1] for s in scans} == {"postings", "credits"}
    assert any("gram" in s[3] and "part" in s[2] for s in scans)


def test_catalog_follows_its_folder(spark, tmp_path):
    import shutil

    for name in ("part", "lineitem", "supplier"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    first = C.catalog(spark, str(tmp_path)).songs.count()
    assert C.catalog(spark, str(tmp_path)).index == C.catalog(spark, str(tmp_path)).index
    import pyarrow.parquet as pq

    t = pq.read_table(tmp_path / "part.parquet")
    (tmp_path / "part.parquet").unlink()
    pq.write_table(t.slice(0, 50), tmp_path / "part.parquet")
    assert (first, C.catalog(spark, str(tmp_path)).songs.count()) == (200, 50)
