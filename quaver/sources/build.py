"""A catalog from a wiki: lists of works, their pages, credits and counts, published as one version of a store (S-10, S-13 to S-16, S-21, S-22).

Whatever has been fetched stays in the work folder, so a build that failed goes on where it stopped; the store changes
only when every page is there.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, pages, stats
from ..operators.versioned import Commit, Snapshot, Store
from ..session import stored
from .catalog import Catalog
from .fetch import Opener, Policy, Progress, answers, fetch_into, tag_hits

#: Versions of the tables and of the records in them.
SCHEMA_VERSION, DETAIL_VERSION = "1", "1"
LENGTH_RULE = "nfc-graphemes-without-blanks"
#: The rank of the list that all works are taken from first.
SOURCE = -1


class Incomplete(RuntimeError):
    """Some pages could not be had."""


def lists(spark: SparkSession, source_url: str, tags: tuple[tuple[str, int], ...], tag_base: str) -> DataFrame:
    """(tag, tag_rank, score, url) of the source list and of the popularity tags, in the order given."""
    rows = [("", SOURCE, 0, source_url)] + [(label, k, score, None) for k, (label, score) in enumerate(tags)]
    df = spark.createDataFrame(rows, "tag string, tag_rank int, score int, url string")
    return df.withColumn("url", F.coalesce("url", F.concat(F.lit(tag_base), F.regexp_replace(F.url_encode("tag"), r"\+", "%20"))))


def songs(hits: DataFrame) -> DataFrame:
    """Every title once, from the source list before the tags, numbered in that order, with its best tag."""
    first = hits.groupBy("title").agg(F.min_by(F.struct("tag_rank", "position", "song_url"), F.struct("tag_rank", "position")).alias("r")).select("title", "r.*")
    ordered = stats.numbered(first, "sort_order", [], ["tag_rank"], "position").select("title", "song_url", F.col("sort_order").cast("int").alias("sort_order"))
    best = corpus.best_tag(hits.filter(F.col("tag_rank") >= 0)).select("title", "score", F.col("tag").alias("label"), F.col("position").cast("int").alias("order"))
    parts = X.title_parts(F.col("raw_title"))
    rows = corpus.with_popularity(ordered, best).withColumnRenamed("title", "raw_title")
    named = [c.alias(k) for k, c in parts.items()]
    return rows.select("raw_title", "song_url", *named, X.title_length(parts["title"]).alias("title_length"), "sort_order", "popularity_score", "popularity_label", "popularity_order")


def people(details: DataFrame) -> DataFrame:
    """(song_url, role, name, normalized_name) of the composers in stored records; of names that are equal in normal form the first stays."""
    names = F.from_json(F.get_json_object("payload_json", "$.credits.composer"), "array<string>")
    rows = details.select(F.col("url").alias("song_url"), F.posexplode(names).alias("at", "name")).withColumn("normalized_name", X.credit_name(F.col("name"))).filter("normalized_name <> ''")
    first = rows.groupBy("song_url", "normalized_name").agg(F.min_by("name", "at").alias("name"))
    return first.select("song_url", F.lit("composer").alias("role"), "name", "normalized_name")


def _metadata(spark: SparkSession, found: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(found.items()), "key string, value string")


def build(
    store: Store,
    source_url: str,
    folder: str,
    tags: tuple[tuple[str, int], ...] = (),
    tag_base: str = "",
    site: pages.Site = pages.Site(),
    policy: Policy = Policy(),
    opener: Opener | None = None,
    passes: int = 3,
    progress: Progress | None = None,
    say: Callable[[str], None] = lambda line: None,
) -> Commit:
    """Fetch, extract and publish songs, details, people and metadata; raises :class:`Incomplete` and leaves the store alone if pages are missing."""
    spark = store.spark
    hits = stored(tag_hits(lists(spark, source_url, tags, tag_base), f"{folder}/lists", site, policy, opener, passes=passes))
    if hits.filter(F.col("tag_rank") == SOURCE).isEmpty():
        raise Incomplete(f"no works listed at {source_url}")
    every = stored(songs(hits))
    count = every.count()
    say(f"{count} works listed")
    urls = every.filter("song_url <> ''").select(F.col("song_url").alias("url")).distinct()
    left = fetch_into(urls, f"{folder}/pages", policy, opener, passes, progress=progress).count()
    if left:
        raise Incomplete(f"{left} pages could not be had")
    got = answers(spark, f"{folder}/pages").join(urls, "url", "left_semi").select("url", F.col("body").alias("html"))
    details = stored(pages.details(got, site).withColumn("schema_version", F.lit(DETAIL_VERSION)))
    found = {
        "schema_version": SCHEMA_VERSION, "detail_schema_version": DETAIL_VERSION, "source_url": source_url, "fetched_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "song_count": str(count), "detail_count": str(details.count()), "title_length_rule": LENGTH_RULE, "popularity_source_tags": ",".join(t for t, _ in tags),
    }
    tables = {"songs": (every, ("song_url",)), "details": (details, ("url",)), "people": (people(details), ("song_url",)), "metadata": (_metadata(spark, found), ("key",))}
    done = store.rebuild(tables, whole)
    say(f"version {done.number} published")
    return done


def whole(snapshot: Snapshot) -> None:
    """No detail or credit without its song, and as many as the metadata say."""
    keys = snapshot.table("songs").select(F.col("song_url").alias("url")).distinct()
    for name, key in (("details", "url"), ("people", "song_url")):
        lost = snapshot.table(name).select(F.col(key).alias("url")).join(keys, "url", "left_anti")
        if not lost.isEmpty():
            raise ValueError(f"{name} without a song: {lost.first().url}")
    told = {r.key: r.value for r in snapshot.table("metadata").collect()}  # a handful
    for key, name in (("song_count", "songs"), ("detail_count", "details")):
        if told[key] != str(snapshot.table(name).count()):
            raise ValueError(f"{key} is {told[key]}")


def catalog(snapshot: Snapshot) -> Catalog:
    """The tables of one version, for searches and statistics."""
    return Catalog(*(snapshot.table(t) for t in ("songs", "details", "people")))
