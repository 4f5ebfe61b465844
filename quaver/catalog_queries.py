"""Queries of the catalog operators over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import checks, corpus, enrich, pages, scans, search, selection, stats, store
from .operators.versioned import Commit, Store
from .session import shared_folder, stored
from .sources import catalog as C

Query = Callable[[SparkSession, str], DataFrame]
_FIELDS = "title, coalesce(composer_names, '') AS artist, artist_note, title_length, s.song_url, popularity_label, popularity_score, published_year, sort_order"
_FROM = "FROM songs s JOIN details d ON s.song_url = d.url LEFT JOIN (SELECT song_url, string_agg(name, ' / ' ORDER BY name) AS composer_names FROM people GROUP BY 1) n ON n.song_url = s.song_url"
_TAIL = "popularity_score DESC, popularity_order, sort_order"


def _search(where: str = "", lead: str = "", page: str = "LIMIT 50") -> str:
    return f"{C.SQL} SELECT {_FIELDS} {_FROM} {'WHERE ' + where if where else ''} ORDER BY {lead}{_TAIL} {page}"


_COMPOSER = "EXISTS (SELECT 1 FROM people p WHERE p.song_url = s.song_url AND contains(p.normalized_name, 'supplier#00000000'))"
_SEARCHES: dict[str, tuple[dict, str]] = {
    "search_default": ({}, _search()),
    "search_length": ({"length": 9}, _search("title_length = 9")),
    "search_label": ({"labels": ("PROMO", "LARGE")}, _search("popularity_label IN ('PROMO', 'LARGE')")),
    "search_year": ({"year": 1997}, _search("published_year = 1997")),
    "search_composer": ({"composer": " SUPPLIER#00000000"}, _search(_COMPOSER)),
    "search_combined": ({"composer": "supplier#00000000", "labels": ("PROMO",), "length": 9}, _search(f"{_COMPOSER} AND popularity_label = 'PROMO' AND title_length = 9")),
    "search_len_asc": ({"sort": "title_length_asc"}, _search(lead="title_length, ")),
    "search_len_desc": ({"sort": "title_length_desc"}, _search(lead="title_length DESC, ")),
    "search_year_asc": ({"sort": "published_year_asc", "limit": None}, _search(lead="published_year ASC NULLS LAST, ", page="")),
    "search_year_desc": ({"sort": "published_year_desc", "offset": 50}, _search(lead="published_year DESC NULLS LAST, ", page="LIMIT 50 OFFSET 50")),
    "search_page_past_end": ({"offset": 100_000_000}, _search(page="LIMIT 50 OFFSET 100000000")),
}


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = F.element_at(F.create_map(*[F.lit(x) for pair in (("purchase", 1200), ("signup", 1000), ("click", 950), ("view", 800), ("error", 750)) for x in pair]), F.col("event_type"))
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in (("purchase", 0), ("signup", 1), ("click", 2), ("view", 3), ("error", 4)) for x in pair]), F.col("event_type"))
    return C.read(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("title"), F.col("event_type").alias("tag"), rank.alias("tag_rank"), scored.alias("score"), F.col("event_id").alias("position"))


_TAGS = "SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS title, event_type AS tag, CASE event_type WHEN 'purchase' THEN 1200 WHEN 'signup' THEN 1000 WHEN 'click' THEN 950 WHEN 'view' THEN 800 ELSE 750 END::INT AS score, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS tag_rank, event_id AS position FROM events"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.read(spark, sf_dir, "documents").select("doc_id", "text")


def _entities(text: str) -> str:
    for name, sign in (("copy;", "©"), ("middot;", "·"), ("quot;", '"'), ("amp;?", "&")):
        text = f"regexp_replace({text}, '&{name}', '{sign}', 'g')"
    return text


#: Titles and texts of the given pages: what lies between tags and comments, outside scripts and styles.
_TEXTS = """
WITH bare AS (SELECT url, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'g'), '<[A-Za-z/][^<>]*$', '') AS h FROM pages),
texts AS (SELECT url, regexp_extract(h, '(?is)<title>(.*?)</title>', 1) AS t, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS told FROM bare)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.read(spark, sf_dir, "pages")


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tags(spark, sf_dir).select("title", "position", "tag")
    return corpus.merge_unique(t.filter("tag = 'purchase'"), t.filter("tag = 'view'"), t.filter("tag = 'click'")).select("title", "tag", "position")


_DERIVED: dict[str, tuple[Query, str | None]] = {
    "search_far_page": (lambda s, d: search.search(C.placed(s, d, "title_length_desc"), "title_length_desc", 50, 1200), f"{_search(lead='title_length DESC, ', page='LIMIT 50 OFFSET 1200')}"),
    "search_far_filtered": (lambda s, d: search.search(C.catalog(s, d), "published_year_desc", 50, 300, 0, labels=("PROMO", "LARGE", "ECONOMY")), _search("popularity_label IN ('PROMO', 'LARGE', 'ECONOMY')", "published_year DESC NULLS LAST, ", "LIMIT 50 OFFSET 300")),
    "search_short_composer": (lambda s, d: search.search(C.catalog(s, d), composer="#0"), _search("EXISTS (SELECT 1 FROM people p WHERE p.song_url = s.song_url AND contains(p.normalized_name, '#0'))")),
    "median_prices": (lambda s, d: selection.medians(C.read(s, d, "lineitem"), "l_returnflag", "l_extendedprice", 500), "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1"),
    "search_total": (lambda s, d: search.total(C.catalog(s, d), labels=("PROMO",), composer="supplier#00000000"), f"{C.SQL} SELECT count(*) AS total FROM songs s JOIN details d ON s.song_url = d.url WHERE popularity_label = 'PROMO' AND {_COMPOSER}"),
    "detail_lookup": (lambda s, d: search.detail(C.catalog(s, d), "https://catalog.example.test/pages/42.html").select("url", "published_year"), f"{C.SQL} SELECT url, published_year FROM details WHERE url = 'https://catalog.example.test/pages/42.html'"),
    "worklist": (lambda s, d: search.worklist(C.catalog(s, d)), f"{C.SQL} SELECT song_url FROM songs"),
    "popularity_labels": (lambda s, d: stats.by_label(C.songs(s, d)).select("popularity_label"), f"{C.SQL} SELECT DISTINCT popularity_label FROM songs WHERE popularity_label <> ''"),
    "stats_by_length": (lambda s, d: stats.buckets(C.songs(s, d), "title_length"), f"{C.SQL} SELECT title_length, count(*) AS n FROM songs GROUP BY 1"),
    "stats_by_year": (lambda s, d: stats.buckets(C.details(s, d), "published_year"), f"{C.SQL} SELECT published_year, count(*) AS n FROM details WHERE published_year IS NOT NULL GROUP BY 1"),
    "stats_by_label": (lambda s, d: stats.by_label(C.songs(s, d)), f"{C.SQL} SELECT popularity_label, count(*) AS n FROM songs WHERE popularity_label <> '' GROUP BY 1"),
    "stats_top_composers": (lambda s, d: stats.top_composers(C.people(s, d)), f"{C.SQL} SELECT min(name) AS name, count(DISTINCT song_url) AS n FROM people GROUP BY normalized_name ORDER BY n DESC, name LIMIT 30"),
    "stats_scalars": (lambda s, d: stats.scalars(C.catalog(s, d)), f"{C.SQL} SELECT (SELECT count(*) FROM songs) AS songs, (SELECT count(*) FROM details) AS details, (SELECT count(published_year) FROM details) AS with_year, (SELECT count(DISTINCT song_url) FROM people) AS with_composer"),
    "stats_bars": (lambda s, d: stats.bars(stats.buckets(C.songs(s, d), "title_length")), f"{C.SQL}, c AS (SELECT title_length, count(*) AS n FROM songs GROUP BY 1) SELECT title_length, n, greatest(4, round(100 * n / (SELECT max(n) FROM c)))::BIGINT AS width FROM c"),
    "tag_resolution": (lambda s, d: corpus.best_tag(_tags(s, d)), f"SELECT title, score, tag, position FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, tag_rank, position) AS r FROM ({_TAGS})) WHERE r = 1"),
    "merge_unique": (_merge, f"SELECT title, tag, position FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY CASE tag WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, position) AS r FROM ({_TAGS}) WHERE tag IN ('purchase', 'view', 'click')) WHERE r = 1"),
    "title_split": (lambda s, d: C.songs(s, d).select("raw_title", "title", "artist", "artist_note"), f"{C.SQL} SELECT raw_title, title, artist, artist_note FROM songs"),
    "title_length": (lambda s, d: _docs(s, d).select("doc_id", X.title_length(F.col("text")).cast("long").alias("n")), "SELECT doc_id, length_grapheme(regexp_replace(nfc_normalize(text), '\\s', '', 'g'))::BIGINT AS n FROM documents"),
    "clean_text": (lambda s, d: _docs(s, d).select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("h")), "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents"),
    "useful_lines_count": (lambda s, d: _docs(s, d).select("doc_id", F.size(X.useful_lines(F.col("text"))).cast("long").alias("n")), "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS n FROM documents"),
    "nfkc_names": (lambda s, d: C.read(s, d, "supplier").select("s_suppkey", X.credit_name(F.col("s_name")).alias("name")), "SELECT s_suppkey, lower(trim(s_name)) AS name FROM supplier"),
    "page_title": (lambda s, d: _pages(s, d).select("page_id", corpus.page_title(F.col("html")).alias("title")), "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages"),
    "page_links": (lambda s, d: corpus.links(_pages(s, d)).select("page_id", F.col("position").cast("long").alias("position"), "href"), "SELECT page_id, (i - 1)::BIGINT AS position, l[i] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"'']', 1) AS l FROM pages))"),
    "page_link_count": (lambda s, d: stats.buckets(corpus.links(_pages(s, d)), "page_id"), "SELECT page_id, sum(len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"'']', 1)))::BIGINT AS n FROM pages GROUP BY 1 HAVING n > 0"),
    "page_records": (lambda s, d: pages.details(_pages(s, d)), f"{_TEXTS} SELECT url, '{{\"page_title\":' || to_json(trim(regexp_replace({_entities('t')}, '\\s+', ' ', 'g'))) || ',\"reading\":\"\",\"published_year\":null,\"credits\":{{}},\"introduction\":[],\"videos\":{{\"niconico\":[],\"youtube\":[]}},\"related_videos\":{{\"niconico\":[],\"youtube\":[]}},\"source_url\":' || to_json(url) || '}}' AS payload_json, NULL::INT AS published_year FROM texts"),
    "page_lines": (lambda s, d: pages.page_lines(_pages(s, d)).select("url", F.size("lines").cast("long").alias("n"), F.md5(F.array_join("lines", "\n")).alias("h")), f"{_TEXTS}, told AS (SELECT url, list_filter(list_transform(string_split({_entities('told')}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM texts) SELECT url, len(l) AS n, md5(array_to_string(l, chr(10))) AS h FROM told"),
    "last_page": (lambda s, d: _pages(s, d).select("page_id", corpus.last_page(F.col("html")).alias("n")), "SELECT page_id, coalesce(list_max(list_transform(regexp_extract_all(html, '[?&]p=(\\d+)', 1), lambda x: x::INT)), 1) AS n FROM pages"),
    "url_parts": (lambda s, d: _pages(s, d).select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path")), "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages"),
    "url_decode": (lambda s, d: _pages(s, d).select("page_id", X.url_decoded(F.concat(F.regexp_replace("url", "e", "%65"), F.lit("%E3%81%8B+%2f%zz"))).alias("url")), "SELECT page_id, url || 'か+/%zz' AS url FROM pages"),
    "json_props": (lambda s, d: C.read(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")), "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events"),
    "json_counters": (lambda s, d: checks.json_counters(C.read(s, d, "events"), "props"), "SELECT count(*) AS n, count(*) FILTER (WHERE NOT json_valid(props)) AS invalid, count(*) FILTER (WHERE json_type(props) = 'OBJECT') AS objects FROM events"),
    "row_checks": (lambda s, d: enrich.issues(C.details(s, d), 2026).select("url", F.concat_ws(",", "checks").alias("checks")), f"{C.SQL} SELECT url, 'missing_credits,missing_introduction,missing_primary_videos' || CASE WHEN published_year IS NULL THEN ',missing_published_year' WHEN published_year < 2000 OR published_year > 2027 THEN ',suspicious_published_year' ELSE '' END AS checks FROM details"),
    "issue_counts": (lambda s, d: enrich.issue_counts(enrich.issues(C.details(s, d), 2026)), f"{C.SQL} SELECT c.name AS \"check\", count(url) AS n FROM (VALUES {', '.join(f'({k!r})' for k in enrich.CHECKS)}) c(name) LEFT JOIN details ON c.name IN ('missing_credits', 'missing_introduction', 'missing_primary_videos') OR c.name = 'missing_published_year' AND published_year IS NULL OR c.name = 'suspicious_published_year' AND (published_year < 2000 OR published_year > 2027) GROUP BY 1"),
    "orphan_details": (lambda s, d: checks.orphans(C.details(s, d).select("url"), C.people(s, d), "url", "song_url"), f"{C.SQL} SELECT url FROM details WHERE url NOT IN (SELECT song_url FROM people)"),
    "markers": (lambda s, d: scans.lacking(_docs(s, d).withColumn("name", F.col("doc_id").cast("string")), {"1": ("the", "no such passage"), "2": ("",)}), "SELECT m.doc_id::VARCHAR AS name, marker FROM (VALUES (1, 'the'), (1, 'no such passage'), (2, '')) m(doc_id, marker) LEFT JOIN documents d ON m.doc_id = d.doc_id WHERE d.doc_id IS NULL OR NOT contains(text, marker)"),
    "duplicate_headings": (lambda s, d: stats.duplicates(_docs(s, d).select(F.md5("text").alias("h")), "h"), "SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING n > 1"),
    "profile_latency": (lambda s, d: stats.latency(C.read(s, d, "events"), "event_type", "value"), "SELECT event_type, round(min(value), 2) AS min_ms, round(median(value), 2) AS median_ms, round(max(value), 2) AS max_ms FROM events GROUP BY 1"),
}

_WIKI = "WITH p AS (SELECT p_partkey AS k, p_name, p_brand, 'https://catalog.example.test/pages/' || p_partkey || '.html' AS url, lpad(p_partkey::VARCHAR, 11, 'A') AS own, lpad(p_partkey::VARCHAR, 11, 'B') AS other FROM part)"
SITE = pages.Site(title_ending="Songs Wiki", tag_path="/w/tag/")


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, dealt to all cores: they come from a table of one row group."""
    return C.wiki(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.details(_wiki(spark, sf_dir), SITE)


def _record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.records(_wiki(spark, sf_dir), SITE)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _record(spark, sf_dir)
    every = [F.transform(pages.flat_videos(F.col(f"d.{section}")), _of(section)) for section in enrich.SECTIONS]
    return d.select("url", F.explode(F.concat(*every)).alias("r")).select("url", "r.section", "r.service", "r.entry.id", pages.thumbnail(F.col("r.entry")).alias("thumbnail"), pages.thumbnail(F.col("r.entry"), 1).alias("next_thumbnail"))


def _of(section: str):
    return lambda x: F.struct(F.lit(section).alias("section"), x["service"].alias("service"), x["entry"].alias("entry"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(enrich.video_ids(_records(spark, sf_dir)))


def _told(videos: DataFrame) -> DataFrame:
    """What two services might tell of the videos: a third whole, a third broken, a third nothing."""
    ids = videos.withColumn("k", F.regexp_extract("id", "([0-9]+)$", 1).cast("long"))
    niconico = F.concat(F.lit("<r><thumb><title> N "), "k", F.lit("</title><thumbnail_url>https://n.test/"), "k", F.lit("</thumbnail_url></thumb></r>"))
    youtube = F.concat(F.lit('{"title": " T '), "k", F.lit('", "thumbnail_url": "https://t.test/'), "k", F.lit('"}'))
    body = F.when(F.col("k") % 3 == 0, F.when(F.col("service") == "niconico", niconico).otherwise(youtube)).when(F.col("k") % 3 == 1, F.lit("<{"))
    return ids.withColumn("body", body).select("service", "id", enrich.answer("service", "id", "body").alias("r")).select("service", "id", "r.*")


def _fetch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = stored(_answers(spark, sf_dir))  # read twice, so that pages are parsed once
    return enrich.fetch_summary(told.select("service", "id"), told.filter("title is not null"))


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[Store, Commit]:
    """Stored records, whose videos take what the services tell."""
    kept = _own_store(spark)
    kept.rebuild({"details": (_records(spark, sf_dir), ("url",))})
    told = _told(enrich.video_ids(kept.snapshot().table("details")))
    return kept, enrich.refreshed(kept, "details", told.filter("title is not null"))


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _refreshed(spark, sf_dir)[0].snapshot().table("details")
    at = lambda path: F.get_json_object("payload_json", path)
    return rows.select("url", at("$.videos.youtube[0].title").alias("title"), at("$.videos.youtube[0].thumbnail_url").alias("first"), at("$.related_videos.niconico[0].thumbnail_url").alias("thumbnail"))


def _refresh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, done = _refreshed(spark, sf_dir)
    return kept.snapshot().table("details").agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(done.counts["rows"]).cast("long").alias("records"), F.lit(done.counts["updated"]).cast("long").alias("entries"))


_IDS = f"{_WIKI}, ids AS (SELECT 'youtube' AS service, own AS id, k FROM p UNION ALL SELECT 'youtube', other, k FROM p UNION ALL SELECT 'niconico', 'sm' || k, k FROM p)"
_TITLE = "CASE k % 3 WHEN 0 THEN (CASE service WHEN 'niconico' THEN 'N ' ELSE 'T ' END) || k WHEN 1 THEN CASE service WHEN 'niconico' THEN 'ニコニコ動画' ELSE 'YouTube' END END"
_THUMBNAIL = "CASE k % 3 WHEN 0 THEN (CASE service WHEN 'niconico' THEN 'https://n.test/' ELSE 'https://t.test/' END) || k WHEN 1 THEN CASE service WHEN 'niconico' THEN 'https://nicovideo.cdn.nimg.jp/thumbnails/' || k || '/' || k || '.L' ELSE 'https://img.youtube.com/vi/' || id || '/mqdefault.jpg' END END"


def _variants(spark: SparkSession, sf_dir: str) -> dict[str, list[tuple[str, str]]]:
    n = str(C.read(spark, sf_dir, "part").count())
    return {
        "whole": [("schema_version", "2"), ("detail_schema_version", "2"), ("song_count", n), ("detail_count", n)],
        "lacking": [("schema_version", "2"), ("song_count", n)],
        "wrong": [("schema_version", "1"), ("detail_schema_version", "2"), ("song_count", "x"), ("detail_count", "7")],
    }


_REQUIRED = ("detail_count", "detail_schema_version", "schema_version", "song_count")


def _per_variant(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    every = None
    for name, pairs in _variants(spark, sf_dir).items():
        one = of(spark.createDataFrame(pairs, "key string, value string")).withColumn("variant", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return every


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(stats.scalars(C.catalog(spark, sf_dir)).select("songs", "details"))  # one row, for six variants
    plain = _per_variant(spark, sf_dir, lambda m: checks.readiness(counts, m, _REQUIRED)).withColumn("strict", F.lit(False))
    strict = _per_variant(spark, sf_dir, lambda m: checks.readiness(counts, m, _REQUIRED, {"schema_version": "2"}, True)).withColumn("strict", F.lit(True))
    return plain.unionByName(strict)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(enrich.core_counts(C.catalog(spark, sf_dir), "2"))  # one row, for three variants
    out = _per_variant(spark, sf_dir, lambda m: enrich.store_report(counts, m, _REQUIRED, {"schema_version": "2", "detail_schema_version": "2"}))
    return out.select("variant", F.concat_ws("; ", "errors").alias("errors"), F.concat_ws("; ", "warnings").alias("warnings"), "ok")


def _made_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each part, every ninth one whole and the others each with one fault."""
    good = {"credits": {"composer": ["a"]}, "introduction": ["text"], "videos": {"youtube": [{"id": "x"}]}, "published_year": 2010}
    faults = [{}, None, {"credits": {}}, {"credits": {"composer": [" "]}}, {"credits": {"composer": ["see HTTPS://x.test"]}}, {"introduction": []}, {"videos": {"youtube": [{"id": ""}]}}, {"published_year": None}, {"published_year": 1999}]
    payloads = F.array(*[F.lit("{" if x is None else json.dumps(good | x)) for x in faults])
    k = F.col("p_partkey") % 9
    return C.read(spark, sf_dir, "part").select(C._url("p_partkey").alias("url"), F.element_at(payloads, (k + 1).cast("int")).alias("payload_json"), F.when(k != 7, 2010).alias("published_year"))


_FAULTS = "['', 'invalid_json', 'missing_credits', 'missing_composer', 'suspicious_composer', 'missing_introduction', 'missing_primary_videos', 'missing_published_year', 'suspicious_published_year,published_year_mismatch']"


def _bare_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that holds all it must, but no composer, year or thumbnail."""
    c = C.catalog(spark, sf_dir)
    details = c.details.select("url", F.lit('{"videos":[{"id":"x","title":"t"}]}').alias("payload_json"), F.lit(None).cast("int").alias("published_year"), F.lit("2").alias("schema_version"))
    counts = stored(enrich.core_counts(C.Catalog(c.songs, details, c.people.filter("role = 'vocalist'")), "2"))
    n = F.col("n").cast("string")
    told = F.create_map(F.lit("song_count"), n, F.lit("detail_count"), n, F.lit("schema_version"), F.lit("2"), F.lit("detail_schema_version"), F.lit("2"), F.lit("fetched_at"), F.lit("now"), F.lit("title_length_rule"), F.lit("r"))
    metadata = c.songs.agg(F.count(F.lit(1)).alias("n")).select(F.explode(told).alias("key", "value"))
    out = enrich.store_report(counts, metadata, _REQUIRED, {"schema_version": "2", "detail_schema_version": "2"})
    return out.crossJoin(F.broadcast(counts.select("songs"))).select("songs", F.concat_ws("; ", "errors").alias("errors"), F.concat_ws("; ", "warnings").alias("warnings"), "ok")


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tags(spark, sf_dir).select("tag", "tag_rank", F.col("position").alias("event_id")).withColumn("page", F.floor(F.col("event_id") / 1000))
    rows = stats.numbered(rows, "tag_order", ["tag"], ["page"], "event_id")
    return stats.numbered(rows, "sort_order", [], ["tag_rank", "page"], "event_id").select("event_id", "tag_order", "sort_order")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ['{"videos":[{"title":"a","thumbnail_url":"b"},{"title":""},1]}', '{"related_videos":[{"thumbnail_url":"x"}]}', "{bad", '{"videos":{"youtube":[]}}']
    rows = C.read(spark, sf_dir, "events").select(F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("event_id") % 4 + 1).cast("int")).alias("payload_json"))
    return enrich.content_counts(rows)


def _popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(label, score, label.lower(), k) for k, (label, score) in enumerate(C.LABELS[:4])], "title string, score int, label string, order int")
    return corpus.with_popularity(C.read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("title")), known)


def _own_store(spark: SparkSession) -> Store:
    """A store of its own for a query, which goes when the application ends."""
    made = Store(spark, f"{shared_folder(spark)}/quaver/store-{uuid.uuid4().hex}")
    place, files = store._files(spark, made.path)
    files.deleteOnExit(place)
    return made


def _customers(spark: SparkSession, sf_dir: str) -> tuple[Store, Commit]:
    """Customers, over which their orders are upserted."""
    old = C.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit(-1).cast("long").alias("version"))
    new = C.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("version"))
    kept = _own_store(spark)
    kept.rebuild({"customers": (old, ("c_custkey",))})
    return kept, kept.upsert("customers", new, "version")


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir)[0].snapshot().table("customers")


def _upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, done = _customers(spark, sf_dir)
    return kept.snapshot().table("customers").agg(F.count(F.lit(1)).alias("n")).select("n", *(F.lit(v).cast("long").alias(k) for k, v in done.counts.items()))


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = C.read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("who"), (F.col("l_linenumber") * 10).alias("note"), "l_linenumber")
    old = lines.filter("l_linenumber = 1").drop("l_linenumber")
    kept = _own_store(spark)
    kept.rebuild({"notes": (old, ("l_orderkey",))})
    kept.replace_children("notes", lines.filter("l_orderkey % 10 = 0"), ("l_orderkey", "who"), "l_linenumber")
    return kept.snapshot().table("notes")


def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: C.read(spark, sf_dir, t) for t in ("region", "nation")}
    return store.dump(tables, {"by_region": ("nation", ("n_regionkey", "n_name")), "a_name": ("region", ("r_name",))})


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of documents for each part: even ones link to those of twice their key and of two more, modulo the number of parts; odd ones stand in circles of three."""
    n = C.read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("d"), c.cast("string"), F.lit(".md"))
    circle = F.floor(k / 6) * 6 + F.when(k % 6 == 1, 3).when(k % 6 == 3, 5).otherwise(1)
    link = lambda c: F.concat(F.lit("[to]("), name(c), F.lit(")\n"))
    rows = C.read(spark, sf_dir, "part").crossJoin(F.broadcast(n))  # one row
    return rows.select(name(k).alias("name"), F.when(k % 2 == 0, F.concat(link(2 * k % F.col("n")), link((2 * k + 2) % F.col("n")))).otherwise(link(circle)).alias("text"))


_LINKED = """
WITH RECURSIVE n AS (SELECT count(*) AS n FROM part),
edges AS (
  SELECT 'd' || p_partkey || '.md' AS a, 'd' || (2 * p_partkey % n) || '.md' AS b FROM part, n WHERE p_partkey % 2 = 0
  UNION SELECT 'd' || p_partkey || '.md', 'd' || ((2 * p_partkey + 2) % n) || '.md' FROM part, n WHERE p_partkey % 2 = 0
  UNION SELECT 'd' || p_partkey || '.md', 'd' || (p_partkey // 6 * 6 + CASE p_partkey % 6 WHEN 1 THEN 3 WHEN 3 THEN 5 ELSE 1 END) || '.md' FROM part WHERE p_partkey % 2 = 1),
names AS (SELECT 'd' || p_partkey || '.md' AS name FROM part),
walk AS (SELECT 'd2.md' AS name UNION SELECT b FROM walk JOIN edges ON a = walk.name JOIN names ON names.name = b)
SELECT name, 'out of reach' AS problem, '' AS detail FROM names WHERE name NOT IN (SELECT name FROM walk) AND name IN (SELECT b FROM edges WHERE a <> b)
"""


def _dump_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given in the wrong order: what others refer to comes first."""
    tables = {t: C.read(spark, sf_dir, t) for t in ("customer", "nation", "region")}
    keys = {"region": (("r_regionkey",),), "nation": (("n_nationkey",), ("n_name",)), "customer": (("c_custkey",),)}
    to = lambda column, table, key: (store.Reference((column,), table, (key,)),)
    return store.dump(tables, keys=keys, references={"nation": to("n_regionkey", "region", "r_regionkey"), "customer": to("c_nationkey", "nation", "n_nationkey")})


_DUMP_KEYS = """
SELECT k - 1 AS step, 'DROP TABLE IF EXISTS "' || t || '";' AS statement FROM (VALUES (1, 'customer'), (2, 'nation'), (3, 'region')) AS v(k, t)
UNION ALL SELECT 3, 'CREATE TABLE "region" ("r_regionkey" INTEGER, "r_name" TEXT, PRIMARY KEY ("r_regionkey"));'
UNION ALL SELECT 4, 'CREATE TABLE "nation" ("n_nationkey" INTEGER, "n_name" TEXT, "n_regionkey" INTEGER, PRIMARY KEY ("n_nationkey"), UNIQUE ("n_name"), FOREIGN KEY ("n_regionkey") REFERENCES "region" ("r_regionkey") ON DELETE CASCADE);'
UNION ALL SELECT 5, 'CREATE TABLE "customer" ("c_custkey" INTEGER, "c_name" TEXT, "c_nationkey" INTEGER, "c_acctbal" REAL, "c_mktsegment" TEXT, PRIMARY KEY ("c_custkey"), FOREIGN KEY ("c_nationkey") REFERENCES "nation" ("n_nationkey") ON DELETE CASCADE);'
UNION ALL SELECT 6, 'INSERT INTO "region" ("r_regionkey", "r_name") VALUES (' || r_regionkey || ', ''' || r_name || ''');' FROM region
UNION ALL SELECT 7, 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ');' FROM nation
UNION ALL SELECT 8, 'INSERT INTO "customer" ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment") VALUES (' || c_custkey || ', ''' || c_name || ''', ' || c_nationkey || ', ' || c_acctbal || ', ''' || c_mktsegment || ''');' FROM customer
"""


_DUMP = """
SELECT 0 AS step, 'DROP TABLE IF EXISTS "nation";' AS statement UNION ALL SELECT 1, 'DROP TABLE IF EXISTS "region";'
UNION ALL SELECT 2, 'CREATE TABLE "region" ("r_regionkey" INTEGER, "r_name" TEXT);' UNION ALL SELECT 3, 'CREATE TABLE "nation" ("n_nationkey" INTEGER, "n_name" TEXT, "n_regionkey" INTEGER);'
UNION ALL SELECT 4, 'INSERT INTO "region" ("r_regionkey", "r_name") VALUES (' || r_regionkey || ', ''' || replace(r_name, '''', '''''') || ''');' FROM region
UNION ALL SELECT 5, 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ');' FROM nation
UNION ALL SELECT 6, 'CREATE INDEX "a_name" ON "region" ("r_name");' UNION ALL SELECT 7, 'CREATE INDEX "by_region" ON "nation" ("n_regionkey", "n_name");'
"""


def _text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("p_name"), F.col("p_partkey").cast("string")
    rows = C.read(spark, sf_dir, "part")
    say = F.lit
    return rows.select(
        "p_partkey",
        X.nfc(F.concat(say("か\u3099e\u0301 "), t)).alias("nfc"),
        X.like_escaped(F.concat(t, say("%_\\"))).alias("escaped"),
        X.unescaped_title(F.concat(say("  A &amp; &#x304B;&#x3099; "), t, say(" "))).alias("unescaped"),
        X.credit_name(F.concat(say(" ＡＢ　"), F.upper(t), say("ß "))).alias("credit_name"),
        X.url_decoded(F.concat(say("a%20b+c%E3%81%8B%2F"), k)).alias("decoded"),
        X.sql_literal(F.concat(t, say("'s"))).alias("literal"),
        X.parenthesis_balance(F.concat(say("（("), t, say(")"))).cast("long").alias("balance"),
        X.without_parentheses(F.concat(say("（ "), t, say(")"))).alias("bare"),
        X.host(F.concat(say("HTTPS://Www.Host"), k, say(".test:80/x?y"))).alias("host"),
        X.slug(F.concat(say(" The "), t, say("! (かな)-"), k)).alias("slug"),
        X.title_length(F.concat(t, say(" \u200b\u2060\u3000👨‍👩‍👧\r\n"))).cast("long").alias("clusters"),
        X.whole_number(F.when(F.col("p_partkey") % 2 == 0, k).otherwise(t))[0].alias("number"),
        X.whole_number(F.when(F.col("p_partkey") % 2 == 0, k).otherwise(t))[1].alias("no_number"),
        X.utc_now(F.to_timestamp(F.lit("2024-05-06 07:08:09"))).alias("moment"),
        F.array_join(enrich.missing(("b", "a", "c"), F.array(say("b"), F.substring(t, 1, 1))), ",").alias("missing"),
    )


_TEXT_RULES = """
SELECT p_partkey, 'がé ' || p_name AS nfc, p_name || '\\%\\_\\\\' AS escaped, 'A & が ' || p_name AS unescaped, 'ab ' || lower(p_name) || 'ss' AS credit_name,
  'a b+cか/' || p_partkey AS decoded, '''' || p_name || '''''s''' AS literal, 1::BIGINT AS balance, p_name AS bare, 'www.host' || p_partkey || '.test' AS host,
  'the-' || replace(p_name, ' ', '-') || '-かな-' || p_partkey AS slug, (length(replace(p_name, ' ', '')) + 1)::BIGINT AS clusters,
  CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS number, CASE WHEN p_partkey % 2 = 1 THEN 'not a whole number: ' || p_name END AS no_number, '2024-05-06T07:08:09+00:00' AS moment,
  array_to_string(list_sort(list_filter(['b', 'a', 'c'], lambda x: x <> 'b' AND x <> p_name[1])), ',') AS missing
FROM part
"""


def _crawling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("page_id", F.concat(F.lit("https://w.test/t?q="), F.col("page_id").cast("string")).alias("u"), (F.col("page_id") % 3 + 1).cast("int").alias("last"))
    asked = F.when(F.col("page_id") % 4 == 0, (F.col("page_id") % 50).cast("double"))
    return rows.select("page_id", F.array_join(corpus.page_urls(F.col("u"), F.col("last")), " ").alias("urls"), corpus.retry_delay((F.col("page_id") % 6 + 1).cast("int"), asked).alias("wait"))


_CRAWLING = "SELECT page_id, array_to_string(list_transform(range(1, page_id % 3 + 2), lambda p: 'https://w.test/t?q=' || page_id || CASE WHEN p > 1 THEN '&p=' || p ELSE '' END), ' ') AS urls, least(coalesce(CASE WHEN page_id % 4 = 0 THEN (page_id % 50)::DOUBLE END, 2.0 * pow(2.0, page_id % 6)), 30.0) AS wait FROM pages"
_LINES = "(SELECT doc_id, l[i] AS t, i::BIGINT AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
#: Addresses as numbers, outside of the special networks.
_PUBLIC = """list_max(o) <= 255 AND NOT regexp_matches(value, '(^|[.])0[0-9]') AND NOT (
  n < 16777216 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 2886729728 AND 2887778303
  OR (n BETWEEN 3221225472 AND 3221225727 AND n NOT IN (3221225481, 3221225482)) OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3232235520 AND 3232301055
  OR n BETWEEN 3323068416 AND 3323199487 OR n BETWEEN 3325256704 AND 3325256959 OR n BETWEEN 3405803776 AND 3405804031 OR n >= 3758096384)"""
_SECRET = r"(?i)\b(api[_-]?key|token|secret|passw(or)?d|private[_-]?key|cloudflare[_-]?api[_-]?token|github[_-]?token)\b\s*[:=]\s*[''\x22]?([A-Za-z0-9_./+=:-]{12,})"
_FAILED = "'missing_credits,missing_introduction,missing_primary_videos' || CASE WHEN published_year IS NULL THEN ',missing_published_year' WHEN published_year < 2000 OR published_year > 2027 THEN ',suspicious_published_year' ELSE '' END"

_DERIVED |= {
    "wiki_records": (lambda s, d: _record(s, d).select("url", "d.page_title", "d.reading", "d.published_year", "d.source_url"), f"{_WIKI} SELECT url, p_name AS page_title, CASE WHEN k % 2 = 0 THEN 'よみ' || k ELSE '' END AS reading, (2004 + k % 20)::INT AS published_year, url AS source_url FROM p"),
    "wiki_credits": (lambda s, d: _record(s, d).select("url", F.explode(pages.credit_rows(F.col("d"))).alias("r")).select("url", "r.field", F.array_join("r.names", "|").alias("names")), f"{_WIKI} SELECT url, r.field, r.names FROM (SELECT url, unnest([{{'field': 'reading', 'names': CASE WHEN k % 2 = 0 THEN 'よみ' || k ELSE '' END}}, {{'field': 'lyricist', 'names': p_brand || '|Lyric ' || k}}, {{'field': 'composer', 'names': p_name}}, {{'field': 'arranger', 'names': p_name}}, {{'field': 'vocalist', 'names': 'Voice ' || (k % 7) || ' feat. Guest ' || (k % 5) || '（調声：Tuner ' || (k % 3) || '）'}}]) AS r FROM p) WHERE r.names <> ''"),
    "wiki_introduction": (lambda s, d: _record(s, d).select("url", F.array_join("d.introduction", "|").alias("told")), f"{_WIKI} SELECT url, CASE WHEN k % 2 = 0 THEN 'This is the sentence of part ' || k || '.' ELSE '第' || k || '作として公開された曲である。|終わりのない' || k || '行' END AS told FROM p"),
    "wiki_videos": (_entries, f"{_WIKI} SELECT url, r.section, r.service, r.id, r.t || '/' || r.a AS thumbnail, r.t || '/' || r.b AS next_thumbnail FROM (SELECT url, unnest([{{'section': 'videos', 'service': 'YouTube', 'id': own, 't': 'https://img.youtube.com/vi/' || own, 'a': 'maxresdefault.jpg', 'b': 'hqdefault.jpg'}}, {{'section': 'related_videos', 'service': 'ニコニコ', 'id': 'sm' || k, 't': 'https://nicovideo.cdn.nimg.jp/thumbnails/' || k, 'a': k || '.L', 'b': k || '.M'}}, {{'section': 'related_videos', 'service': 'YouTube', 'id': other, 't': 'https://img.youtube.com/vi/' || other, 'a': 'maxresdefault.jpg', 'b': 'hqdefault.jpg'}}]) AS r FROM p)"),
    "wiki_listed": (lambda s, d: pages.listed(C.wiki_tags(s, d)).withColumn("position", F.col("position").cast("long")), "SELECT p_brand AS url, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position, p_name || ' & ' || p_partkey || ' / x' AS title, 'https://wiki.example.test/w/pages/' || p_partkey || '.html' AS song_url FROM part"),
    "video_ids": (lambda s, d: enrich.video_ids(_records(s, d)), f"{_IDS} SELECT service, id FROM ids"),
    "video_answers": (_answers, f"{_IDS} SELECT service, id, {_TITLE} AS title, {_THUMBNAIL} AS thumbnail_url FROM ids"),
    "fetch_summary": (_fetch_summary, f"{_IDS} SELECT service, count(*) AS total, count(*) FILTER (WHERE k % 3 = 0) AS success, count(*) FILTER (WHERE k % 3 = 2) AS failure, count(*) FILTER (WHERE k % 3 = 1) AS fallback FROM ids GROUP BY 1"),
    "apply_metadata": (_applied, f"{_WIKI} SELECT url, CASE k % 3 WHEN 0 THEN 'T ' || k WHEN 1 THEN 'YouTube' ELSE 'YouTube ' || own END AS title, CASE k % 3 WHEN 0 THEN 'https://t.test/' || k ELSE 'https://img.youtube.com/vi/' || own || CASE k % 3 WHEN 1 THEN '/mqdefault.jpg' ELSE '/maxresdefault.jpg' END END AS \"first\", CASE k % 3 WHEN 0 THEN 'https://n.test/' || k ELSE 'https://nicovideo.cdn.nimg.jp/thumbnails/' || k || '/' || k || '.L' END AS thumbnail FROM p"),
    "refresh_counts": (_refresh_counts, f"{_WIKI} SELECT count(*) AS n, count(*) FILTER (WHERE k % 3 < 2) AS records, 3 * count(*) FILTER (WHERE k % 3 < 2) AS entries FROM p"),
    "upsert_counts": (_upsert_counts, "SELECT (SELECT count(*) FROM customer) AS n, 0::BIGINT AS inserted, count(DISTINCT o_custkey) AS replaced FROM orders"),
    "readiness": (_ready, "SELECT variant, strict, variant = 'whole' OR (variant = 'wrong' AND NOT strict) AS ready FROM (VALUES ('whole'), ('lacking'), ('wrong')) v(variant), (VALUES (true), (false)) t(strict)"),
    "made_row_checks": (lambda s, d: enrich.issues(_made_rows(s, d), 2026).select("url", F.concat_ws(",", "checks").alias("checks")), f"SELECT 'https://catalog.example.test/pages/' || p_partkey || '.html' AS url, {_FAULTS}[p_partkey % 9 + 1] AS checks FROM part WHERE p_partkey % 9 > 0"),
    "store_warnings": (_bare_store, "SELECT count(*) AS songs, '' AS errors, 'no record has a composer; no record has a year; no video has a thumbnail' AS warnings, true AS ok FROM part"),
    "store_report": (_report, "SELECT variant, CASE variant WHEN 'whole' THEN '' WHEN 'lacking' THEN 'metadata lacks detail_count; metadata lacks detail_schema_version; ' ELSE 'schema_version is 1, not 2; song_count is x but there are ' || n || '; detail_count is 7 but there are ' || n || '; ' END || old || ' details of another version' AS errors, '' AS warnings, false AS ok FROM (VALUES ('whole'), ('lacking'), ('wrong')) v(variant), (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 50 = 0) AS old FROM part)"),
    "core_counts": (lambda s, d: enrich.core_counts(C.catalog(s, d), "2"), f"{C.SQL} SELECT (SELECT count(*) FROM songs) AS songs, (SELECT count(*) FROM details) AS details, (SELECT count(published_year) FROM details) AS with_year, (SELECT count(DISTINCT song_url) FROM people) AS with_composer, (SELECT count(*) FROM details WHERE schema_version <> '2') AS version_mismatch, 0::BIGINT AS invalid, 0::BIGINT AS videos, 0::BIGINT AS related_videos, 0::BIGINT AS with_thumbnail, 0::BIGINT AS with_title, (SELECT count(*) FROM details WHERE url NOT IN (SELECT song_url FROM songs)) AS orphan_details, (SELECT count(*) FROM people WHERE song_url NOT IN (SELECT song_url FROM songs)) AS orphan_people"),
    "content_counts": (_contents, "SELECT count(*) FILTER (WHERE event_id % 4 = 2) AS invalid, 3 * count(*) FILTER (WHERE event_id % 4 = 0) AS videos, count(*) FILTER (WHERE event_id % 4 = 1) AS related_videos, count(*) FILTER (WHERE event_id % 4 < 2) AS with_thumbnail, count(*) FILTER (WHERE event_id % 4 = 0) AS with_title FROM events"),
    "payloads": (lambda s, d: enrich.payloads(C.details(s, d)).select("url", F.try_variant_get("record", "$.page_title", "string").alias("page_title"), F.try_variant_get("record", "$.published_year", "int").alias("published_year")), f"{C.SQL} SELECT url, p_name AS page_title, published_year FROM details"),
    "issue_report": (lambda s, d: enrich.issue_report(C.catalog(s, d), 2026, None).select("title", "song_url", F.concat_ws(",", "checks").alias("checks")), f"{C.SQL} SELECT title, song_url, {_FAILED} AS checks FROM songs JOIN details ON song_url = url"),
    "popularity_lookup": (_popular, "SELECT p_partkey, p_type AS title, CASE p_type WHEN 'PROMO' THEN 1200 WHEN 'LARGE' THEN 1000 WHEN 'ECONOMY' THEN 950 WHEN 'STANDARD' THEN 800 ELSE 0 END AS popularity_score, CASE WHEN p_type IN ('PROMO', 'LARGE', 'ECONOMY', 'STANDARD') THEN lower(p_type) ELSE '' END AS popularity_label, CASE p_type WHEN 'LARGE' THEN 1 WHEN 'ECONOMY' THEN 2 WHEN 'STANDARD' THEN 3 ELSE 0 END AS popularity_order FROM part"),
    "numbering": (_numbers, f"SELECT position AS event_id, row_number() OVER (PARTITION BY tag ORDER BY position) AS tag_order, row_number() OVER (ORDER BY tag_rank, position) AS sort_order FROM ({_TAGS})"),
    "projection": (lambda s, d: search.tsv(C.songs(s, d), ("artist", "title_length", "popularity_label")), f"{C.SQL} SELECT title || chr(9) || artist || chr(9) || title_length || chr(9) || popularity_label AS line FROM songs"),
    "upserted": (_upserted, "SELECT c_custkey, c_name AS name, -1::BIGINT AS version FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, arg_max(o_orderpriority || ' ' || o_orderkey, o_orderkey), max(o_orderkey) FROM orders GROUP BY 1"),
    "children_replaced": (_children, "SELECT l_orderkey, l_suppkey % 3 AS who, l_linenumber * 10 AS note FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 10 <> 0 UNION ALL SELECT l_orderkey, l_suppkey % 3, min(l_linenumber) * 10 FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY 1, 2"),
    "sql_dump": (_dump, _DUMP),
    "sql_dump_keys": (_dump_keys, _DUMP_KEYS),
    "lost_documents": (lambda s, d: scans.lost(_linked(s, d), ("d2.md",)), _LINKED),
    "text_rules": (_text_rules, _TEXT_RULES),
    "crawling": (_crawling, _CRAWLING),
    "orphan_orders": (lambda s, d: checks.orphans(C.read(s, d, "customer").select("c_custkey"), C.read(s, d, "orders").filter("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "scan_domains": (lambda s, d: scans.domains(_pages(s, d).select(F.col("page_id").alias("doc_id"), F.concat(F.lit("x\nsee "), "url").alias("text")), allowed=("example.org",)), "SELECT page_id AS doc_id, 2::BIGINT AS line, value FROM (SELECT page_id, regexp_extract(url, 'https?://([^/,\\s''\"`]+)', 1) AS value FROM pages) WHERE contains(value, '.') AND NOT contains(value, '$') AND NOT regexp_matches(lower(value), '^(?:example\\.org|(?:.*\\.)?example\\.com|www\\.example\\.com|localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|example\\.test)(?::[^:]*)?$')"),
    "scan_emails": (lambda s, d: checks.emails(_docs(s, d)), f"SELECT doc_id, line, value FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, '\\b[[:alnum:]._%+\\-]+@[[:alnum:].\\-]+\\.[[:alpha:]]{{2,}}\\b')) AS value FROM {_LINES}) WHERE value NOT LIKE '%@example.com'"),
    "scan_ips": (lambda s, d: checks.public_ips(_docs(s, d)), f"SELECT doc_id, line, value FROM (SELECT *, o[1]::BIGINT * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] AS n FROM (SELECT doc_id, line, value, list_transform(string_split(value, '.'), lambda x: x::INT) AS o FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, '\\b[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}\\b')) AS value FROM {_LINES}))) WHERE {_PUBLIC}"),
    "scan_secrets": (lambda s, d: checks.secret_assignments(_docs(s, d)).select("doc_id", "line", F.md5("value").alias("h")), f"SELECT doc_id, line, md5(value) AS h FROM (SELECT doc_id, line, regexp_extract(t, '{_SECRET}', 3) AS value FROM {_LINES} WHERE t NOT LIKE '%replace-with-%' AND t NOT LIKE '%example%') WHERE value <> ''"),
}


def queries() -> dict[str, Query]:
    found = {k: (lambda s, d, how=how: search.search(C.catalog(s, d), **how)) for k, (how, _) in _SEARCHES.items()}
    return found | {k: q for k, (q, _) in _DERIVED.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _SEARCHES.items()} | {k: sql for k, (_, sql) in _DERIVED.items() if sql}
