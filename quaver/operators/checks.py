"""Integrity, readiness and text scans (J-4, J-5, Q-1, Q-2, Q-5, A-15, T-1..T-4, X-32)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the scans; Java's U is what a Python pattern does by itself: word ends, spaces and letter case of all of Unicode.
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IPV4 = r"(?U)\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
ASSIGNMENT = r"(?iU)\b(?:api[_-]?key|token|secret|password|passwd|private[_-]?key|cloudflare[_-]?api[_-]?token|github[_-]?token)\b\s*[:=]\s*['\"]?([A-Za-z0-9_./+=:-]{12,})"
PLACEHOLDERS = "replace-with-|example"


def _network(text: str) -> tuple[int, int]:
    at, size = text.split("/")
    return reduce(lambda n, x: n * 256 + int(x), at.split("."), 0), int(size)


#: Networks that are private, loopback, link-local, reserved, for documents or multicast, and two addresses within that are not.
SPECIAL = tuple(map(_network, "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()))
EXEMPT = tuple(_network(f"{x}/32")[0] for x in ("192.0.0.9", "192.0.0.10"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """J-4, J-5: an explicit anti join."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def metadata_map(metadata: DataFrame) -> DataFrame:
    """S-2."""
    return metadata.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def readiness(counts: DataFrame, metadata: DataFrame, required: tuple[str, ...], versions: dict[str, str] | None = None, match_counts: bool = False) -> DataFrame:
    """Q-1 (required keys, details = songs) and with ``versions`` and ``match_counts`` the stricter Q-2.

    counts: one row of songs and details.
    """
    m = F.col("metadata")
    ok = F.forall(F.array(*[F.lit(k) for k in required]), lambda k: F.map_contains_key(m, k)) & (F.col("songs") == F.col("details")) & (F.col("songs") > 0)
    for k, v in (versions or {}).items():
        ok = ok & F.coalesce(F.try_element_at(m, F.lit(k)) == v, F.lit(False))
    if match_counts:
        for k, c in (("song_count", "songs"), ("detail_count", "details")):
            ok = ok & F.coalesce(F.expr(f"try_cast(try_element_at(metadata, '{k}') AS BIGINT)") == F.col(c), F.lit(False))
    return counts.crossJoin(F.broadcast(metadata_map(metadata))).select(F.coalesce(ok, F.lit(False)).alias("ready"))


def json_counters(rows: DataFrame, column: str) -> DataFrame:
    """A-15: rows, invalid ones, and objects."""
    v = F.try_parse_json(column)
    kind = F.schema_of_variant(v)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("invalid"), F.count_if(kind.startswith("OBJECT")).alias("objects"))


def line_hits(docs: DataFrame, pattern: str, group: int = 0, sign: str = "") -> DataFrame:
    """(doc_id, line, value) of each match, by line from 1; ``sign`` is in every match."""
    # texts without a match are not taken apart
    wanted = docs if sign else docs.filter(F.col("text").rlike(pattern))
    lines = wanted.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    lines = lines.filter(F.contains("t", F.lit(sign))) if sign else lines
    found = lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.explode(F.regexp_extract_all("t", F.lit(pattern), F.lit(group))).alias("value"))
    return found


def emails(docs: DataFrame) -> DataFrame:
    """T-1."""
    # few texts hold the sign without which there is none, and few lines of these
    return line_hits(docs.filter(F.contains("text", F.lit("@"))), EMAIL, sign="@").filter(~F.col("value").endswith("@example.com"))


def public_ip(c: Column) -> Column:
    """X-32: valid and in none of the private, loopback, link-local, reserved or multicast ranges."""
    p = F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    whole = F.forall(F.split(c, r"\."), lambda x: ~x.rlike("^0[0-9]")) & F.forall(p, lambda x: x <= 255)  # a leading zero makes it no address
    number = F.aggregate(p, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    special = reduce(lambda x, y: x | y, [F.shiftright(number, 32 - size) == first >> (32 - size) for first, size in SPECIAL])
    exempt = number.isin(*EXEMPT)
    return whole & (~special | exempt)


def public_ips(docs: DataFrame) -> DataFrame:
    """T-2."""
    return line_hits(docs, IPV4).filter(public_ip(F.col("value")))


def secret_assignments(docs: DataFrame) -> DataFrame:
    """T-4: the first assignment of each line without a placeholder."""
    lines = docs.filter(F.col("text").rlike(ASSIGNMENT)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).filter(~F.col("t").rlike(PLACEHOLDERS))
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.regexp_extract("t", ASSIGNMENT, 1).alias("value")).filter("value <> ''")
