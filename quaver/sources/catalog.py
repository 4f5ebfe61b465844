"""The catalog's tables over the driver's tables, so that each query has a SQL twin.

They are built once for each application and folder, and stored: titles are normalised, split, counted and numbered when
the catalog is built, and searches read the columns that they need.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import trigrams
from ..operators.stats import numbered
from ..session import shared_folder

#: Stand-ins for the popularity tags: part types with their scores; the last has no label.
LABELS = (("PROMO", 1200), ("LARGE", 1000), ("ECONOMY", 950), ("STANDARD", 800), ("MEDIUM", 750), ("SMALL", 0))


#: Parts that one task numbers within their type.
NUMBERED_AT_ONCE = 500_000


@dataclass
class Catalog:
    """index: where :mod:`trigrams` has indexed the composers; places: all songs by place in an order, and the places of each part (:func:`placed`)."""

    songs: DataFrame
    details: DataFrame
    people: DataFrame
    index: str | None = None
    places: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S-1: a read-only table scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _url(key: str):
    return F.concat(F.lit("https://catalog.example.test/pages/"), F.col(key).cast("string"), F.lit(".html"))


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = X.nfc(F.concat_ws("/", "p_name", "p_brand", F.col("p_partkey").cast("string")))
    score = F.element_at(F.create_map(*[F.lit(x) for pair in LABELS for x in pair]), F.col("p_type"))
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_type", raw.alias("raw_title"), F.coalesce(score, F.lit(0)).alias("popularity_score"))
    rows = numbered(rows.withColumn("bucket", F.floor(F.col("p_partkey") / NUMBERED_AT_ONCE)), "popularity_order", ["p_type"], ["bucket"], "p_partkey")
    parts = X.title_parts(F.col("raw_title"))
    return rows.select(
        "raw_title", _url("p_partkey").alias("song_url"), *[c.alias(k) for k, c in parts.items()], X.title_length(parts["title"]).alias("title_length"), (F.col("p_partkey") + 1).cast("int").alias("sort_order"),
        "popularity_score", F.when(F.col("popularity_score") > 0, F.col("p_type")).otherwise("").alias("popularity_label"), F.col("popularity_order").cast("int").alias("popularity_order"),
    )


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_partkey", "l_suppkey").distinct()
    named = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), X.credit_name(F.col("s_name")).alias("normalized_name"))
    rows = first.join(named, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(_url("l_partkey").alias("song_url"), F.lit("composer").alias("role"), "name", "normalized_name")


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = read(spark, sf_dir, "lineitem").filter("l_quantity >= 47").groupBy("l_partkey").agg(F.min(F.year("l_shipdate")).alias("published_year"))
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name").join(year, F.col("p_partkey") == F.col("l_partkey"), "left")
    payload = F.to_json(F.struct(F.col("p_name").alias("page_title"), F.col("published_year")), {"ignoreNullFields": "false"})
    version = F.when(F.col("p_partkey") % 50 == 0, "1").otherwise("2")
    return rows.select(_url("p_partkey").alias("url"), payload.alias("payload_json"), "published_year", version.alias("schema_version"))


_stored: dict[tuple, str] = {}
_TABLES = (("songs", _songs), ("details", _details), ("people", _people))


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files that the tables are built from: a changed folder is built again."""
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    found = []
    for p in map(at, ("part", "lineitem", "supplier")):
        each = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(p, True)
        while each.hasNext():
            f = each.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The stored tables; the first call of an application for a folder, as it is then, builds them."""
    key = spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir)
    if key not in _stored:
        path = f"{shared_folder(spark)}/quaver/catalog-{uuid.uuid4().hex}"
        for name, make in _TABLES:
            make(spark, sf_dir).write.parquet(f"{path}/{name}")
        trigrams.build(spark.read.parquet(f"{path}/people"), f"{path}/composers")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
        _stored[key] = path
    return Catalog(*(spark.read.parquet(f"{_stored[key]}/{name}") for name, _ in _TABLES), index=f"{_stored[key]}/composers")


_placed: dict[tuple[str, str], str] = {}


def placed(spark: SparkSession, sf_dir: str, sort: str) -> Catalog:
    """The catalog with all songs stored by their place in one order, for pages far from its start; built by the first call."""
    from ..operators import search, selection

    c = catalog(spark, sf_dir)
    root = c.index.removesuffix("/composers")
    path = f"{root}/places-{sort}"
    if (root, sort) not in _placed:
        selection.ranked(search.matching(c), *search.order(sort)).sortWithinPartitions("part", "place").write.partitionBy("part").parquet(path)
        spark.read.parquet(path).groupBy("part").agg(F.min("place").alias("first"), F.max("place").alias("last")).coalesce(1).write.parquet(f"{root}/parts-{sort}")
        _placed[root, sort] = path
    c.places[sort] = spark.read.parquet(path), spark.read.parquet(f"{root}/parts-{sort}")
    return c


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).songs


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).details


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).people


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): a page of a work for each part, of two kinds: with items in its introduction, and with running text."""
    k, say = F.col("p_partkey").cast("string"), F.lit
    video = lambda letter: F.lpad(k, 11, letter)
    mod = lambda n: (F.col("p_partkey") % n).cast("string")
    year = (2004 + F.col("p_partkey") % 20).cast("string")
    head = F.concat(say("<html><head><title>"), "p_name", say(" - Songs Wiki - site</title><script>var a='作詞：none';</script></head><body><a href='/w/tag/"), year, say("%E5%B9%B4'>"), year, say("年</a><a href='/w/tag/2003%E5%B9%B4'>2003年</a>"))
    credits = F.concat(
        say("<p>作詞："), "p_brand", say("、Lyric "), k, say("<br>作曲・編曲：<br>"), "p_name", say("<br>（Twitter）<br>唄：<br>Voice "), mod(7), say(" feat.<br>Guest "), mod(5),
        say("<br>（調声：<br>Tuner "), mod(3), say("<br>）<br>+<br>Short ver.<br>絵：nobody</p><iframe src='https://www.youtube.com/embed/"), video("A"), say("'></iframe><h2>曲紹介</h2>"),
    )
    items = F.concat(say("<ul><li>曲名：『"), "p_name", say("』（よみ"), k, say("）<li>This is the sentence of part "), k, say(".<li>short</ul>"))
    running = F.concat(say("第"), k, say("作として<br>公開された曲である。<br>作詞：x<br>終わりのない"), k, say("行"))
    tail = F.concat(
        say("<h2>歌詞</h2><p>la la</p><h3>英語版</h3><iframe src='https://www.youtube.com/embed/EEEEEEEEEEE'></iframe><h2>関連動画</h2><iframe src='https://ext.nicovideo.jp/thumb/sm"), k,
        say("'></iframe><a href='https://youtu.be/"), video("B"), say("'>w</a><h2>コメント</h2><p>end</p></body></html>"),
    )
    return read(spark, sf_dir, "part").select(_url("p_partkey").alias("url"), F.concat(head, credits, F.when(F.col("p_partkey") % 2 == 0, items).otherwise(running), tail).alias("html"))


def wiki_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): a page for each brand that lists its parts."""
    link = F.concat(F.lit("<a href='/w/pages/"), F.col("p_partkey").cast("string"), F.lit(".html'>"), "p_name", F.lit(" &amp; "), F.col("p_partkey").cast("string"), F.lit(" / x</a>"))
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", link.alias("link")).groupBy("p_brand").agg(F.expr("listagg(link, '') WITHIN GROUP (ORDER BY p_partkey)").alias("links"))
    return rows.select(F.col("p_brand").alias("url"), F.concat(F.lit("<div><a href='/w/pages/0.html'>before</a>タグ検索"), "links", F.lit("人気のタグ<a href='/w/pages/1.html'>after</a></div>")).alias("html"))


SQL = """
WITH songs AS (
  SELECT p_name || '/' || p_brand || '/' || p_partkey AS raw_title, 'https://catalog.example.test/pages/' || p_partkey || '.html' AS song_url,
    trim(nfc_normalize(p_name)) AS title, trim(p_brand) AS artist, p_partkey::VARCHAR AS artist_note,
    length_grapheme(regexp_replace(nfc_normalize(trim(p_name)), '\\s', '', 'g'))::INT AS title_length, (p_partkey + 1)::INT AS sort_order,
    score AS popularity_score, CASE WHEN score > 0 THEN p_type ELSE '' END AS popularity_label, (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey))::INT AS popularity_order
  FROM (SELECT *, CASE p_type WHEN 'PROMO' THEN 1200 WHEN 'LARGE' THEN 1000 WHEN 'ECONOMY' THEN 950 WHEN 'STANDARD' THEN 800 WHEN 'MEDIUM' THEN 750 ELSE 0 END AS score FROM part)),
people AS (
  SELECT DISTINCT 'https://catalog.example.test/pages/' || l_partkey || '.html' AS song_url, 'composer' AS role, s_name AS name, lower(trim(s_name)) AS normalized_name
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1),
details AS (
  SELECT 'https://catalog.example.test/pages/' || p_partkey || '.html' AS url, p_name, y AS published_year, CASE WHEN p_partkey % 50 = 0 THEN '1' ELSE '2' END AS schema_version FROM part
  LEFT JOIN (SELECT l_partkey, min(year(l_shipdate))::INT AS y FROM lineitem WHERE l_quantity >= 47 GROUP BY 1) ON p_partkey = l_partkey)
"""
