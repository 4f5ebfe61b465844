"""Video metadata of stored records and their row checks (N-1 to N-7, A-13, A-14, A-16, J-6, J-8, Q-3 to Q-10, O-20)."""

from __future__ import annotations

import json
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.catalog import Catalog
from .pages import DETAIL, SERVICES, niconico_thumbnails, youtube_thumbnails
from .search import order
from .stats import scalars
from .versioned import Commit, Store

SECTIONS = ("videos", "related_videos")
#: Names of the row checks, in order, and words that no composer's name has.
CHECKS = ("invalid_json", "missing_credits", "missing_composer", "suspicious_composer", "missing_introduction", "missing_primary_videos", "missing_published_year", "suspicious_published_year", "published_year_mismatch")
SUSPICIOUS = ("http", "twitter", "x.com", "instagram", "youtube", "homepage", "ホームページ", "公式サイト")
VARIANTS = "array<variant>"


def _kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _list(v: Column, path: str) -> Column:
    """The array at a path, empty where there is none."""
    return F.coalesce(F.try_variant_get(v, path, VARIANTS), F.array().cast(VARIANTS))


def _strings(v: Column, path: str) -> Column:
    return F.transform(F.filter(_list(v, path), lambda x: _kind(x, "STRING")), lambda x: F.try_variant_get(x, "$", "string"))


def _whole(v: Column, path: str) -> Column:
    """A whole number, null for anything else (also for numbers in quotes)."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(_kind(x, "BIGINT"), F.try_variant_get(v, path, "bigint"))


def video_ids(details: DataFrame, payload: str = "payload_json") -> DataFrame:
    """N-1, N-2, A-13: distinct (service, id) of all video entries; parts of another shape are passed over."""
    v = F.try_parse_json(payload)
    found = [F.transform(_strings_of_ids(v, f"$.{section}.{s}"), _with(s)) for section in SECTIONS for s in SERVICES]
    return details.select(F.explode(F.concat(*found)).alias("r")).select("r.*").filter("id <> ''").distinct()


def _strings_of_ids(v: Column, path: str) -> Column:
    ids = F.transform(F.filter(_list(v, path), lambda x: _kind(x, "OBJECT")), lambda x: F.try_variant_get(x, "$.id", "variant"))
    return F.transform(F.filter(ids, lambda x: _kind(x, "STRING")), lambda x: F.try_variant_get(x, "$", "string"))


def _with(service: str):
    return lambda x: F.struct(F.lit(service).alias("service"), x.alias("id"))


@F.pandas_udf(T.StructType().add("title", "string").add("thumbnail_url", "string"))
def answer(service: pd.Series, video_id: pd.Series, body: pd.Series) -> pd.DataFrame:
    """N-4, N-5: title and thumbnail in a service's answer, with the fallbacks for what is missing or broken; null answers stay null."""

    def one(service, video_id, body):
        if body is None:
            return None, None
        back = SERVICES[service], niconico_thumbnails(video_id)[0] if service == "niconico" else youtube_thumbnails(video_id)[2]
        try:
            if service == "niconico":
                root = ElementTree.fromstring(body)
                got = root.findtext(".//title"), root.findtext(".//thumbnail_url")
            else:
                root = json.loads(body)
                got = (root.get("title"), root.get("thumbnail_url")) if isinstance(root, dict) else (None, None)
        except (ElementTree.ParseError, ValueError):
            return back
        return tuple(x.strip() if isinstance(x, str) and x.strip() else b for x, b in zip(got, back))

    return pd.DataFrame([one(*x) for x in zip(service, video_id, body)], columns=["title", "thumbnail_url"], dtype=object)


def _thumbnails(service: Column, video_id: Column) -> Column:
    n = F.regexp_replace(video_id, "^[A-Za-z]+", "")
    first = F.transform(F.array(F.lit(".L"), F.lit(".M"), F.lit("")), lambda x: F.concat(F.lit("https://nicovideo.cdn.nimg.jp/thumbnails/"), n, F.lit("/"), n, x))
    sizes = F.array(*[F.lit(x) for x in ("maxresdefault", "hqdefault", "mqdefault", "default")])
    second = F.transform(sizes, lambda x: F.concat(F.lit("https://img.youtube.com/vi/"), video_id, F.lit("/"), x, F.lit(".jpg")))
    return F.when(service == "niconico", first).otherwise(second)


def is_fallback(service: Column, video_id: Column, title: Column, thumbnail: Column) -> Column:
    """N-6: the metadata tell no more than the id."""
    stand_in = F.when(service == "niconico", F.element_at(_thumbnails(service, video_id), 1)).otherwise(F.element_at(_thumbnails(service, video_id), 3))
    name = F.when(service == "niconico", SERVICES["niconico"]).otherwise(SERVICES["youtube"])
    return F.coalesce(title == name, F.lit(False)) | F.coalesce(thumbnail == stand_in, F.lit(False))


def fetch_summary(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """A-14: per service, ids, answers that tell something, ids without an answer, fallbacks.

    Metadata are merged, as below: made of texts by functions, they are far larger than the estimate by which Spark would broadcast them.
    """
    both = ids.join(metadata.withColumn("got", F.lit(True)).hint("merge"), ["service", "id"], "left")
    weak = is_fallback(F.col("service"), F.col("id"), F.col("title"), F.col("thumbnail_url"))
    return both.groupBy("service").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("got") & ~weak).alias("success"), F.count_if(F.col("got").isNull()).alias("failure"), F.count_if(F.col("got") & weak).alias("fallback"))


def apply_metadata(details: DataFrame, metadata: DataFrame) -> DataFrame:
    """N-7, J-8: records with the titles and thumbnails of ``metadata`` (service, id, title, thumbnail_url), and how many entries took them.

    Ids alone are joined, and come back as one small map per record; entries without metadata stay as they are.
    Records must have the form of ``pages.DETAIL``; a payload that is no JSON keeps its text.
    """
    ids = details.select("url", F.explode(F.array_distinct(F.concat(*[F.transform(_strings_of_ids(F.try_parse_json("payload_json"), f"$.{section}.{s}"), _with(s)) for section in SECTIONS for s in SERVICES]))).alias("r")).select("url", "r.*")
    per_url = ids.join(metadata.hint("merge"), ["service", "id"]).groupBy("url").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "service", "id"), F.struct("title", "thumbnail_url")))).alias("found"))
    found = lambda service, e: F.try_element_at(F.col("found"), F.concat(F.lit(service + ":"), e["id"]))

    def taken(service):
        def one(e):
            m = found(service, e)
            shown = F.filter(F.array_distinct(F.concat(F.array(m["thumbnail_url"]), _thumbnails(F.lit(service), e["id"]))), lambda x: x != "")
            new = e.withField("title", m["title"]).withField("thumbnail_url", F.element_at(shown, 1)).withField("thumbnail_urls", shown)
            return F.when(m.isNotNull(), new).otherwise(e)

        return one

    rows = details.join(per_url.hint("merge"), "url", "left").withColumn("d", F.from_json("payload_json", DETAIL))
    counts, record = [], F.col("d")
    for section in SECTIONS:
        for s in SERVICES:
            entries = F.col(f"d.{section}.{s}")
            counts.append(F.coalesce(F.size(F.filter(entries, _known(s, found))), F.lit(0)))
            record = record.withField(f"{section}.{s}", F.transform(entries, taken(s)))
    text = F.when(F.col("found").isNull(), F.col("payload_json")).otherwise(F.to_json(record, {"ignoreNullFields": "false"}))
    updated = F.when(F.col("found").isNull(), 0).otherwise(reduce(lambda a, b: a + b, [F.greatest(c, F.lit(0)) for c in counts]))
    return rows.withColumn("payload_json", text).withColumn("updated", updated.cast("long")).drop("found", "d")


def refreshed(store: Store, name: str, metadata: DataFrame) -> Commit:
    """S-17: the stored records that ``metadata`` tells of take it; counts records and, as ``updated``, entries."""
    applied = apply_metadata(store.snapshot().table(name).select("url", "payload_json"), metadata)
    return store.update(name, applied.filter("updated > 0").select("url", "payload_json", "updated"), "updated")


def _known(service, found):
    return lambda e: found(service, e).isNotNull()


def _stated(v: Column, text: Column) -> Column:
    """A text that is not empty, or a number or truth value other than zero and false."""
    return F.coalesce(F.when(_kind(v, "STRING"), text != "").otherwise(~text.isin("0", "false")), F.lit(False))


def row_checks(payload: Column, stored_year: Column, this_year: int) -> Column:
    """Q-9: names of the checks that a record fails, in order."""
    v = F.try_parse_json(payload)
    composers, year = _strings(v, "$.credits.composer"), _whole(v, "$.published_year")
    named = lambda values: F.exists(values, lambda x: F.trim(x) != "")
    has_credits = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.credits", "variant")).rlike("^OBJECT<.+>$"), F.lit(False))
    odd_name = F.exists(composers, lambda x: reduce(lambda a, b: a | b, [F.contains(X.folded(x), F.lit(w)) for w in SUSPICIOUS]))
    services = F.try_variant_get(v, "$.videos", "map<string,variant>")
    with_id = lambda e: _kind(e, "OBJECT") & _stated(F.try_variant_get(e, "$.id", "variant"), F.try_variant_get(e, "$.id", "string"))
    has_video = F.coalesce(F.exists(F.map_values(services), lambda x: F.exists(_list(x, "$"), with_id)), F.lit(False))
    odd = lambda y: (y < 2000) | (y > this_year + 1)
    failed = F.array_compact(F.array(
        F.when(~has_credits, "missing_credits").when(~named(composers), "missing_composer").when(odd_name, "suspicious_composer"),
        F.when(~named(_strings(v, "$.introduction")), "missing_introduction"),
        F.when(~has_video, "missing_primary_videos"),
        F.when(year.isNull() & stored_year.isNull(), "missing_published_year").when(odd(year) | odd(stored_year), "suspicious_published_year"),
        F.when(year != stored_year, "published_year_mismatch"),
    ))
    return F.when(v.isNull(), F.array(F.lit("invalid_json"))).otherwise(failed)


def payloads(details: DataFrame) -> DataFrame:
    """S-4: (url, record) in order of the url; a null record where the payload is no JSON."""
    return details.select("url", F.try_parse_json("payload_json").alias("record")).orderBy("url")


def issue_report(c: Catalog, this_year: int, limit: int | None = 100) -> DataFrame:
    """J-6: (title, song_url, checks) of songs whose record fails a check, by popularity."""
    rows = c.songs.join(c.details.select("url", "payload_json", "published_year"), F.col("song_url") == F.col("url"))
    failed = rows.withColumn("checks", row_checks(F.col("payload_json"), F.col("published_year"), this_year)).filter(F.size("checks") > 0)
    ordered = failed.orderBy(*order("popularity")).select("title", "song_url", "checks")
    return ordered if limit is None else ordered.limit(limit)


def issues(details: DataFrame, this_year: int) -> DataFrame:
    """Records that fail a check."""
    return details.select("url", row_checks(F.col("payload_json"), F.col("published_year"), this_year).alias("checks")).filter(F.size("checks") > 0)


def issue_counts(failing: DataFrame) -> DataFrame:
    """A-16, Q-10: failures of each check, also of those that nothing fails."""
    every = failing.sparkSession.createDataFrame([(c,) for c in CHECKS], "check string")
    n = failing.select(F.explode("checks").alias("check")).groupBy("check").count()
    return every.join(n, "check", "left").select("check", F.coalesce("count", F.lit(0)).alias("n"))


def listed_issues(failing: DataFrame, limit: int | None = 20) -> DataFrame:
    """O-20: None lists all, 0 none."""
    ordered = failing.orderBy("url")
    return ordered if limit is None else ordered.limit(limit)


def missing(required: tuple[str, ...], present: Column) -> Column:
    """Q-3, J-10, U-6: required names that are absent, sorted."""
    return F.array_sort(F.array_except(F.array(*[F.lit(x) for x in required]), present))


def content_counts(details: DataFrame, payload: str = "payload_json") -> DataFrame:
    """A-15: payloads that are no JSON, entries of the lists of videos and related videos, and those with a thumbnail or a title."""
    v = F.try_parse_json(payload)
    entries = lambda k: _list(v, f"$.{k}")
    has = lambda k: lambda e: _kind(e, "OBJECT") & _stated(F.try_variant_get(e, f"$.{k}", "variant"), F.try_variant_get(e, f"$.{k}", "string"))
    size = lambda *lists: F.coalesce(F.sum(reduce(lambda a, b: a + b, [F.size(x) for x in lists])), F.lit(0)).cast("long")
    both = [entries(k) for k in SECTIONS]
    return details.agg(
        F.count_if(v.isNull()).alias("invalid"), size(both[0]).alias("videos"), size(both[1]).alias("related_videos"),
        size(*[F.filter(x, has("thumbnail_url")) for x in both]).alias("with_thumbnail"), size(*[F.filter(x, has("title")) for x in both]).alias("with_title"),
    )


def core_counts(c: Catalog, version: str | None = None) -> DataFrame:
    """Q-4 and the broken references: one row, made of frames of one row each."""
    keys = c.songs.select(F.col("song_url").alias("url")).distinct()
    orphans = lambda df, key: df.select(F.col(key).alias("url")).join(keys, "url", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    other = F.count_if(F.col("schema_version") != version) if version is not None else F.lit(0).cast("long")
    out = scalars(c)
    for one in (
        c.details.agg(other.alias("version_mismatch")), content_counts(c.details),
        orphans(c.details, "url").withColumnRenamed("n", "orphan_details"), orphans(c.people, "song_url").withColumnRenamed("n", "orphan_people"),
    ):
        out = out.crossJoin(F.broadcast(one))
    return out


def store_report(counts: DataFrame, metadata: DataFrame, required: tuple[str, ...], versions: dict[str, str]) -> DataFrame:
    """Q-4, Q-5, Q-8: one row of errors, warnings and ok.

    counts: the row of :func:`core_counts`.
    """
    m = F.coalesce(F.col("metadata"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    at = lambda k: F.try_element_at(m, F.lit(k))
    n = lambda k: F.expr(f"try_cast(try_element_at(metadata, '{k}') AS BIGINT)")
    say = lambda bad, text, *args: F.when(F.coalesce(bad, F.lit(True)), F.format_string(text, *args))
    errors = [F.when(~F.map_contains_key(m, k), f"metadata lacks {k}") for k in required]
    errors += [F.when(F.map_contains_key(m, k) & (at(k) != v), F.format_string(f"{k} is %s, not {v}", at(k))) for k, v in versions.items()]
    errors += [F.when(F.map_contains_key(m, k), say(n(k) != F.col(c), f"{k} is %s but there are %d", at(k), F.col(c))) for k, c in (("song_count", "songs"), ("detail_count", "details"))]
    errors += [F.when(F.col("songs") == 0, "there are no songs"), say(F.col("songs") != F.col("details"), "%d songs but %d details", F.col("songs"), F.col("details"))]
    errors += [F.when(F.col(c) > 0, F.format_string(f"%d {text}", F.col(c))) for c, text in (("orphan_details", "details without a song"), ("orphan_people", "credits without a song"), ("invalid", "details are not JSON"), ("version_mismatch", "details of another version"))]
    filled = F.col("songs") > 0
    warnings = [F.when(filled & (F.col(c) == 0), text) for c, text in (("with_composer", "no record has a composer"), ("with_year", "no record has a year"))]
    warnings.append(F.when(filled & (F.col("videos") > 0) & (F.col("with_thumbnail") == 0), "no video has a thumbnail"))
    one = metadata.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))  # a handful of keys
    return counts.crossJoin(F.broadcast(one)).select(F.array_compact(F.array(*errors)).alias("errors"), F.array_compact(F.array(*warnings)).alias("warnings")).withColumn("ok", F.size("errors") == 0)


def written_report(report: DataFrame, path: str) -> None:
    """S-20: a report as JSON, a line for each row."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
