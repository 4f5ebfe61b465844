"""Facets and totals (A-1..A-10, A-18..A-20, Q-11)."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .selection import medians

if TYPE_CHECKING:
    from ..sources.catalog import Catalog


def buckets(rows: DataFrame, key: str) -> DataFrame:
    """A-5, A-6: counts by key, without nulls, in key order."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(key)


def by_label(songs: DataFrame) -> DataFrame:
    """A-7, A-8: labels by their highest score."""
    g = songs.filter("popularity_label <> ''").groupBy("popularity_label").agg(F.count(F.lit(1)).alias("n"), F.max("popularity_score").alias("_m"))
    return g.orderBy(F.desc("_m"), "popularity_label").drop("_m")


def top_composers(people: DataFrame, k: int = 30) -> DataFrame:
    """A-10: a top-k report, as is the feature."""
    rows = people.filter("role = 'composer'").groupBy("normalized_name", "song_url").agg(F.min("name").alias("name"))
    return rows.groupBy("normalized_name").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(k).select("name", "n")


def scalars(c: Catalog) -> DataFrame:
    """A-1, A-3, A-4: four totals as one row of one-row frames."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    details = c.details.agg(F.count(F.lit(1)).alias("details"), F.count_if(F.col("published_year").isNotNull()).alias("with_year"))
    credited = count(c.people.filter("role = 'composer'").select("song_url").distinct(), "with_composer")
    return count(c.songs, "songs").crossJoin(F.broadcast(details)).crossJoin(F.broadcast(credited))  # each side is one row


def bars(counts: DataFrame) -> DataFrame:
    """A-19: widths in percent of the largest count, at least 4."""
    most = counts.agg(F.greatest(F.lit(1), F.max("n")).alias("most"))
    return counts.crossJoin(F.broadcast(most)).withColumn("width", F.greatest(F.lit(4), F.round(100 * F.col("n") / F.col("most"))).cast("long")).drop("most")


def latency(rows: DataFrame, key: str, ms: str) -> DataFrame:
    """A-18: exact minimum, median and maximum, to two digits."""
    ends = rows.groupBy(key).agg(F.round(F.min(ms), 2).alias("min_ms"), F.round(F.max(ms), 2).alias("max_ms"))
    middle = medians(rows, key, ms).select(F.col(key).alias("_key"), F.round("median", 2).alias("median_ms"))
    return ends.join(middle, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "min_ms", "median_ms", "max_ms")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """A-20."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def statistics(c: Catalog) -> dict[str, DataFrame]:
    """Q-11."""
    return {"scalars": scalars(c), "by_length": buckets(c.songs, "title_length"), "by_year": buckets(c.details, "published_year"), "by_label": by_label(c.songs), "top_composers": top_composers(c.people)}


def numbered(rows: DataFrame, name: str, group: list[str], bucket: list[str], *order: str) -> DataFrame:
    """W-1, W-2: position of each row within its group (of all rows, if there is none) by ``bucket`` and ``order``, from 1.

    Rows are numbered within their bucket, and buckets by a running sum of their counts, so that no task sees a whole group.
    """
    keys = [*group, *bucket]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_own", own).join(starts, keys).withColumn(name, F.col("_start") + F.col("_own")).drop("_own", "_start")


def profile(requests: dict[str, Callable[[], DataFrame]], repeat: int = 3) -> list[tuple[str, float, float, float]]:
    """T-8: (name, minimum, median, maximum milliseconds) of each request, one after another."""
    out = []
    for name, make in requests.items():
        took = []
        for _ in range(repeat):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(1000 * (time.perf_counter() - began))
        out.append((name, *(round(f(took), 2) for f in (min, median, max))))
    return out
