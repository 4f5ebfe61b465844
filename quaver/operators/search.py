"""Catalog search: optional filters, five total orders, paging (P-*, J-1..J-3, A-2, A-9, O-11..O-18, S-5, S-6)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.params import SORTS
from . import trigrams

if TYPE_CHECKING:
    from ..sources.catalog import Catalog


def order(sort: str) -> list[Column]:
    """Every order ends in sort_order, which is unique, so pages never overlap."""
    tail = [F.desc("popularity_score"), F.asc("popularity_order"), F.asc("sort_order")]
    lead = {
        "popularity": [], "title_length_asc": [F.asc("title_length")], "title_length_desc": [F.desc("title_length")],
        "published_year_asc": [F.asc_nulls_last("published_year")], "published_year_desc": [F.desc_nulls_last("published_year")],
    }
    if sort not in SORTS:
        raise ValueError(f"unsupported sort order: {sort}")
    return lead[sort] + tail


def matching(c: Catalog, length: int | None = None, labels: tuple[str, ...] = (), composer: str = "", year: int | None = None) -> DataFrame:
    """Songs with details that satisfy the given filters; filters not given are not in the plan."""
    songs = c.songs
    if length is not None:
        songs = songs.filter(F.col("title_length") == length)
    if labels:
        songs = songs.filter(F.col("popularity_label").isin(*labels))
    details = c.details.select("url", "published_year")
    if year is not None:
        details = details.filter(F.col("published_year") == year)
    out = songs.join(details, songs.song_url == details.url).drop("url")
    wanted = unicodedata.normalize("NFKC", composer).casefold().strip()
    if wanted:
        if c.index:
            hit = trigrams.songs_of(songs.sparkSession, c.index, wanted)
        else:
            hit = c.people.filter((F.col("role") == "composer") & F.col("normalized_name").contains(wanted)).select("song_url").distinct()
        out = out.join(hit, "song_url", "left_semi")
    return out


def composers(people: DataFrame) -> DataFrame:
    """A-9: names of each song, in order, as one string."""
    return people.filter("role = 'composer'").groupBy("song_url").agg(F.expr("listagg(name, ' / ') WITHIN GROUP (ORDER BY name)").alias("composer_names"))


def page(places: DataFrame, parts: DataFrame, limit: int, offset: int) -> DataFrame:
    """O-17: the rows at places offset + 1 to offset + limit; only the parts that hold them are read, and of these what their statistics leave."""
    held = parts.filter((F.col("first") <= offset + limit) & (F.col("last") > offset)).select("part").collect()  # the parts of one page
    return places.filter(F.col("part").isin(*(r.part for r in held)) & F.col("place").between(offset + 1, offset + limit)).drop("part", "place")


#: Rows before a page from which counts are taken first, and works of one popularity that are counted as one group.
FAR, STEP = 10_000, 100_000


def far_page(rows: DataFrame, sort: str, limit: int, offset: int, step: int = STEP) -> DataFrame:
    """O-17: a page deep in any filtered order: counts by the leading keys tell the groups that hold it, and only those are sorted.

    Groups are values of the leading key and of the popularity, with the order within it cut every ``step`` works; the
    driver sees one count of each.
    """
    lead = {"title_length": "title_length", "published_year": "published_year"}.get(sort.rpartition("_")[0])
    keys = {"lead": F.col(lead).cast("int") if lead else F.lit(0), "score": F.col("popularity_score"), "part": F.floor(F.col("popularity_order") / step)}
    counts = rows.groupBy(*(k.alias(n) for n, k in keys.items())).agg(F.count(F.lit(1)).alias("n")).collect()
    down = -1 if sort.endswith("_desc") else 1
    before, held = 0, []
    for g in sorted(counts, key=lambda g: (g.lead is None, down * (g.lead or 0), -g.score, g.part)):
        if not held and before + g.n <= offset:
            before += g.n
        elif not held or before + sum(h.n for h in held) < offset + limit:
            held.append(g)
    own = [reduce(lambda x, y: x & y, [k.eqNullSafe(F.lit(g[n])) for n, k in keys.items()]) for g in held]
    return rows.filter(reduce(lambda x, y: x | y, own, F.lit(False))).orderBy(*order(sort)).offset(offset - before).limit(limit)


def search(c: Catalog, sort: str = "popularity", limit: int | None = 50, offset: int = 0, far: int = FAR, **filters) -> DataFrame:
    """A page, or all rows; without filters, an order whose places are stored gives its pages by them; other pages from ``far`` on are narrowed by counts."""
    keys, people = order(sort), c.people
    rows = page(*c.places[sort], limit, max(0, offset)) if limit is not None and sort in c.places and not any(v not in (None, "", ()) for v in filters.values()) else None
    if rows is None:
        rows = matching(c, **filters)
        if limit is not None:
            rows = far_page(rows, sort, limit, offset) if offset >= far else rows.orderBy(*keys).offset(max(0, offset)).limit(limit)
    if limit is not None:  # names are gathered for the songs of the page only, which are few by its limit
        people = people.join(F.broadcast(rows.select("song_url")) if limit <= 1000 else rows.select("song_url"), "song_url", "left_semi")
    out = rows.join(composers(people), "song_url", "left")
    return out.orderBy(*keys).select("title", F.coalesce("composer_names", F.lit("")).alias("artist"), "artist_note", "title_length", "song_url", "popularity_label", "popularity_score", "published_year", "sort_order")


def total(c: Catalog, **filters) -> DataFrame:
    """A-2: rows of the same filters, without names or order."""
    return matching(c, **filters).agg(F.count(F.lit(1)).alias("total"))


def detail(c: Catalog, url: str) -> DataFrame:
    """S-5: no row if the url is unknown."""
    return c.details.filter(F.col("url") == url).limit(1)


def worklist(c: Catalog, limit: int | None = None, title_length: int | None = None) -> DataFrame:
    """S-6: urls in popularity order."""
    rows = c.songs.filter("song_url <> ''")
    if title_length is not None:
        rows = rows.filter(F.col("title_length") == title_length)
    rows = rows.orderBy(*order("popularity")).select("song_url")
    return rows if limit is None else rows.limit(limit)


def tsv(rows: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """S-19, P-16: title and the chosen columns, tab-separated."""
    return rows.select(F.concat_ws("\t", "title", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))


def drill_down(dimension: str, bucket: object, labels: tuple[str, ...]) -> dict:
    """P-17: the filters of a bucket of the statistics: all labels and nothing else, then the bucket."""
    reset = {"length": None, "labels": labels, "composer": "", "year": None}
    if dimension == "label":
        return reset | {"labels": (bucket,)}
    if dimension not in reset:
        raise ValueError(f"no such dimension: {dimension}")
    return reset | {dimension: bucket}


def representative(c: Catalog, url: str, composer: str, label: str, year: int, length: int = 7) -> dict[str, Callable[[], DataFrame]]:
    """T-8: the nine kinds of requests that a profile times."""
    from .stats import by_label, buckets, scalars

    return {
        "health": lambda: c.songs.select("song_url").limit(1),
        "metadata": lambda: scalars(c),
        "stats": lambda: buckets(c.songs, "title_length").select("n").unionByName(buckets(c.details, "published_year").select("n")).unionByName(by_label(c.songs).select("n")),
        "search_length": lambda: search(c, length=length),
        "search_composer": lambda: search(c, composer=composer),
        "search_year": lambda: search(c, sort="published_year_desc", year=year),
        "search_tag": lambda: search(c, labels=(label,)),
        "search_page_size_200": lambda: search(c, limit=200),
        "song_detail": lambda: detail(c, url),
    }
