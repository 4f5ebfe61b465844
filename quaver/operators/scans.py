"""Scans of text files: domains, links between documents, marks that must be there (T-3, T-5 to T-7, X-11, X-30, P-9, P-12, P-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import stored

#: Hosts and endings of hosts that stand for no real site.
ALLOWED, ALLOWED_ENDINGS = ("example.com", "www.example.com", "localhost", "127.0.0.1", "0.0.0.0", "example.test"), (".example.com",)
URL_HOST = r"https?://([^/,\s'\"`]+)"
LINK = r"(?<!!)\[[^\]]+\]\(([^)]+)\)"


def domains(docs: DataFrame, allowed: tuple[str, ...] = (), settings: tuple[str, ...] = ()) -> DataFrame:
    """T-3: (doc_id, line, value) of hosts in URLs, and in assignments to ``settings``, that are not allowed."""
    found = F.regexp_extract_all("t", F.lit(URL_HOST), F.lit(1))
    if settings:
        assigned = F.regexp_extract_all("t", F.lit(rf"\b(?:{'|'.join(settings)})\b\s*=\s*['\"]?([^'\"\s]+)"), F.lit(1))
        items = F.transform(F.flatten(F.transform(assigned, lambda x: F.split(x, ","))), F.trim)
        found = F.concat(found, F.filter(items, lambda x: F.contains(x, F.lit("."))))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    hits = lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.explode(found).alias("value"))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim("value")), "^[^:]*://", ""), "/.*$", ""), ":[^:]*$", "")
    fine = F.contains(host, F.lit("$")) | ~F.contains(host, F.lit(".")) | host.isin(*ALLOWED, *allowed)
    for ending in ALLOWED_ENDINGS:
        fine = fine | host.endswith(ending)
    return hits.filter(~fine)


def scanned(path: Column, suffixes: tuple[str, ...], skipped: tuple[str, ...]) -> Column:
    """T-5: files by ending, outside of skipped folders."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r".(\.[^.]+)$", 1).isin(*suffixes) & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in skipped]))


def _plain(c: Column) -> Column:
    """Inline code and links of a heading become their text."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "`([^`]+)`", "$1"), r"\[([^\]]+)\]\([^)]+\)", "$1"), "^[ #]+|[ #]+$", "")


def headings(docs: DataFrame) -> DataFrame:
    """X-30: (name, slug) of every heading outside fenced code; docs has name and text."""
    open_text = F.regexp_replace("text", r"(?ms)^```[^\n]*(?:\n.*?^```[^\n]*$|.*\z)", "")
    found = F.regexp_extract_all(open_text, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"), F.lit(1))
    return docs.select("name", F.explode(found).alias("h")).select("name", X.slug(_plain(F.col("h"))).alias("slug"))


def doc_links(docs: DataFrame) -> DataFrame:
    """X-30: (name, target, file, fragment) of local links between documents of one folder."""
    links = docs.select("name", F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("target"))
    link = F.trim(F.regexp_replace(F.trim("target"), "^<(.*)>$", "$1"))
    links = links.withColumn("link", link).filter((link != "") & ~link.rlike("://|^mailto:|^#|^/"))
    path = X.url_decoded(F.regexp_extract("link", r"^([^?#]*)", 1))
    up = path.startswith("../")  # leaves the folder
    file = F.when(path.isin("", "."), F.col("name")).otherwise(F.element_at(F.split(path, "/"), -1))
    return links.filter(~up).select("name", "target", file.alias("file"), X.url_decoded(F.regexp_extract("link", "#(.*)$", 1)).alias("fragment")).filter(F.col("file").endswith(".md"))


def link_failures(docs: DataFrame, entry_points: tuple[str, ...] = ("index.md", "README.md")) -> DataFrame:
    """T-6: (name, problem, detail) of links to missing files and headings, documents without a link to them or out of reach, repeated headings."""
    links, anchors = doc_links(docs), headings(docs)
    names = docs.select(F.col("name").alias("file")).distinct()
    say = lambda df, problem, detail: df.select("name", F.lit(problem).alias("problem"), F.col(detail).alias("detail"))
    no_file = say(links.join(names, "file", "left_anti"), "missing file", "target")
    known = anchors.select(F.col("name").alias("file"), F.col("slug").alias("fragment")).distinct()
    no_heading = say(links.filter("fragment <> ''").join(names, "file", "left_semi").join(known, ["file", "fragment"], "left_anti"), "missing heading", "target")
    orphans = say(names.filter(~F.col("file").isin(*entry_points)).join(links, "file", "left_anti").withColumnRenamed("file", "name").withColumn("detail", F.lit("")), "no link here", "detail")
    repeated = say(anchors.groupBy("name", "slug").count().filter("count > 1"), "repeated heading", "slug")
    return no_file.unionByName(no_heading).unionByName(orphans).unionByName(repeated).unionByName(lost(docs, entry_points))


def reached(docs: DataFrame, entry_points: tuple[str, ...] = ("index.md", "README.md")) -> DataFrame:
    """T-6: (name, steps): how many links it takes at least from an entry point to each document; null where no path leads.

    Steps spread along the links round by round, over stored tables; a round asks only the documents that the last one found.
    """
    names = stored(docs.select("name").distinct())
    edges = stored(doc_links(docs).select("name", F.col("file").alias("to")).distinct().join(names.select(F.col("name").alias("to")), "to", "left_semi"))
    known = stored(names.filter(F.col("name").isin(*entry_points)).withColumn("steps", F.lit(0)))
    fresh, step = known, 0
    while not fresh.isEmpty():
        step += 1
        next_ = edges.join(fresh.select("name"), "name", "left_semi").select(F.col("to").alias("name")).distinct()
        fresh = stored(next_.join(known, "name", "left_anti").withColumn("steps", F.lit(step)))
        known = stored(known.unionByName(fresh))
    return names.join(known, "name", "left")


def lost(docs: DataFrame, entry_points: tuple[str, ...] = ("index.md", "README.md")) -> DataFrame:
    """T-6: (name, problem, detail) of documents that no path of links reaches, though some link leads to them: they are in circles of their own, or behind one."""
    apart = reached(docs, entry_points).filter("steps is null").select("name")
    linked = doc_links(docs).filter("name <> file").select(F.col("file").alias("name")).distinct()
    return apart.join(linked, "name", "left_semi").select("name", F.lit("out of reach").alias("problem"), F.lit("").alias("detail"))


def lacking(docs: DataFrame, marks: dict[str, tuple[str, ...]]) -> DataFrame:
    """T-7: (name, marker) that a document should contain and does not; the marks are a given, short list."""
    wanted = docs.sparkSession.createDataFrame([(n, m) for n, ms in marks.items() for m in ms], "name string, marker string")
    seen = docs.select("name", "text").filter(F.col("name").isin(*marks)).join(F.broadcast(wanted), "name").filter(F.contains("text", "marker"))
    return wanted.join(seen.select("name", "marker").distinct(), ["name", "marker"], "left_anti")


def page_url(c: Column, host: str, path: str = r"/pages/[0-9]+\.html", whole: bool = False) -> Column:
    """P-12: a page of the site; with ``whole`` no query or fragment may follow."""
    if whole:
        return c.rlike(rf"^https://{host.replace('.', '[.]')}{path}$")
    return F.coalesce((F.try_parse_url(c, F.lit("PROTOCOL")) == "https") & (F.try_parse_url(c, F.lit("HOST")) == host) & F.try_parse_url(c, F.lit("PATH")).rlike(f"^{path}$"), F.lit(False))


def works(songs: DataFrame, stops: tuple[str, ...]) -> DataFrame:
    """P-9: entries whose title part is none of the stop words."""
    return songs.filter(~F.col("title").isin(*stops)) if stops else songs


def default_labels(scores: dict[str, int]) -> tuple[str, ...]:
    """P-18: all labels but that of the least score."""
    return tuple(k for k, v in scores.items() if v > min(scores.values()))
