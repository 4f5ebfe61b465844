"""Substring search of names by an inverted index of trigrams (P-4, J-3).

The index lies beside the catalog: postings (trigram to name) parted by the hash of the trigram and sorted by it, and
credits (name to song) parted by the hash of the name.  A search reads the postings of its own trigrams, intersects
them, verifies the names that are left, and reads the credits of those names' parts.  A pattern of fewer than three
characters has no trigram: the names themselves are searched, each once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, PARTS = 3, 32
POSTINGS, CREDITS = "part int, gram string, name string", "part int, name string, song_url string"


def _part(column: str):
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int").alias("part")


def grams(text: str) -> list[str]:
    """The distinct trigrams of a pattern."""
    return sorted({text[k : k + SIZE] for k in range(len(text) - SIZE + 1)})


def build(people: DataFrame, path: str) -> None:
    """Write the index of all composers' normalised names."""
    credits = people.filter("role = 'composer' and normalized_name is not null").select(F.col("normalized_name").alias("name"), "song_url").distinct()
    names = credits.select("name").distinct()
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - SIZE + 1, F.lit(1))), lambda i: F.substring("name", i, F.lit(SIZE)))
    postings = names.select("name", F.explode(F.array_distinct(each)).alias("gram")).select(_part("gram"), "gram", "name")
    postings.hint("rebalance", F.col("part")).sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/postings")
    credits.select(_part("name"), "name", "song_url").hint("rebalance", F.col("part")).sortWithinPartitions("part", "name").write.partitionBy("part").parquet(f"{path}/credits")


def names_with(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """(part, name): the names that contain ``wanted``, with the part of their credits."""
    wanted_grams = grams(wanted)
    if wanted_grams:
        parts = [F.pmod(F.xxhash64(F.lit(g)), F.lit(PARTS)).cast("int") for g in wanted_grams]
        own = spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter(F.col("part").isin(*parts) & F.col("gram").isin(*wanted_grams))
        found = own.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted_grams))
    else:
        found = spark.read.schema(CREDITS).parquet(f"{path}/credits").select("name").distinct()
    return found.filter(F.contains("name", F.lit(wanted))).select(_part("name"), "name")


def songs_of(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """(song_url) with a composer whose name contains ``wanted``; the parts without such a name are not read."""
    credits = spark.read.schema(CREDITS).parquet(f"{path}/credits")
    return credits.join(names_with(spark, path, wanted), ["part", "name"]).select("song_url").distinct()
