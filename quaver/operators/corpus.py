"""Corpus assembly and page crawling over stored pages (A-11, U-1, W-1..W-3, S-9..S-12, E-3, X-14..X-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Titles that are not works, dropped by title part (P-9).
NOT_WORKS: tuple[str, ...] = ("曲一覧",)


def best_tag(hits: DataFrame) -> DataFrame:
    """A-11: the highest score of each title; of equal ones the earlier tag, then the earlier position.

    hits: title, tag, tag_rank, score, position.
    """
    pick = F.max_by(F.struct("score", "tag", F.col("position").alias("position")), F.struct("score", -F.col("tag_rank"), -F.col("position")))
    return hits.groupBy("title").agg(pick.alias("b")).select("title", "b.score", "b.tag", "b.position")


def merge_unique(*groups: DataFrame, key: str = "title", ordinal: str = "position") -> DataFrame:
    """U-1: the first row of each key over the groups in turn; an aggregation, so a hot key is pre-aggregated."""
    every = None
    for k, g in enumerate(groups):
        g = g.withColumn("group_rank", F.lit(k))
        every = g if every is None else every.unionByName(g)
    rest = [c for c in every.columns if c != key]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("group_rank", ordinal)).alias("r")).select(key, "r.*")


def last_page(html: Column) -> Column:
    """S-12."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit(r"[?&]p=(\d+)"), F.lit(1)), lambda x: x.cast("int"))), F.lit(1))


def page_urls(base: Column, last: Column) -> Column:
    """S-11: the base url, then the same with ``p`` set to each further page."""
    bare = F.regexp_replace(F.regexp_replace(base, r"([?&])p=[^&]*&?", "$1"), r"[?&]$", "")
    return F.transform(F.sequence(F.lit(1), last), lambda p: F.when(p == 1, base).otherwise(F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("p="), p.cast("string"))))


def retry_delay(attempt: Column, retry_after: Column, base: float = 2.0, most: float = 30.0) -> Column:
    """S-9: seconds to wait before the next attempt."""
    return F.least(F.coalesce(retry_after, F.lit(base) * F.pow(F.lit(2.0), attempt - 1)), F.lit(most))


def page_title(html: Column) -> Column:
    """E-3, without entities."""
    return X.clean_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(pages: DataFrame) -> DataFrame:
    """X-15: (page_id, position, href) of every anchor."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("position", "href"))


def with_popularity(songs: DataFrame, popularity: DataFrame, key: str = "title") -> DataFrame:
    """J-7: songs with the score, label and order of their popularity; 0, empty and 0 where there is none. ``popularity`` has a row for each key."""
    own = popularity.select(key, *[F.col(c).alias(f"popularity_{c}") for c in ("score", "label", "order")])
    default = {"popularity_score": 0, "popularity_label": "", "popularity_order": 0}
    return songs.join(own, key, "left").fillna(default)
