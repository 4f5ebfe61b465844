"""Row checks and video metadata against hand-made records."""

import json

import pytest
from pyspark.sql import functions as F

from quaver.operators import enrich as E
from quaver.operators import pages as P

GOOD = {"credits": {"composer": ["a"]}, "introduction": ["text"], "videos": {"youtube": [{"id": "x"}]}, "published_year": 2010}


@pytest.mark.parametrize(
    "change, stored, checks",
    [
        ({}, 2010, []), ("{", 2010, ["invalid_json"]), (None, None, ["invalid_json"]),
        ({"credits": {}}, 2010, ["missing_credits"]), ({"credits": [1]}, 2010, ["missing_credits"]),
        ({"credits": {"composer": [" ", 3]}}, 2010, ["missing_composer"]), ({"credits": {"composer": "a"}}, 2010, ["missing_composer"]),
        ({"credits": {"composer": ["a", "My HomePage"]}}, 2010, ["suspicious_composer"]),
        ({"introduction": "text"}, 2010, ["missing_introduction"]), ({"videos": {"youtube": [{"id": ""}, {"id": 0}, 3]}}, 2010, ["missing_primary_videos"]), ({"videos": {"youtube": [{"id": "0"}]}}, 2010, []), ({"videos": {"youtube": [{"id": 7}]}}, 2010, []),
        ({"videos": [1]}, 2010, ["missing_primary_videos"]), ({"published_year": None}, None, ["missing_published_year"]), ({"published_year": "2010"}, None, ["missing_published_year"]),
        ({"published_year": 1999}, 2010, ["suspicious_published_year", "published_year_mismatch"]), ({"published_year": None}, 2099, ["suspicious_published_year"]), ({}, 2011, ["published_year_mismatch"]),
    ],
)
def test_row_checks(spark, change, stored, checks):
    payload = change if not isinstance(change, dict) else json.dumps(GOOD | change)
    rows = spark.createDataFrame([("u", payload, stored)], "url string, payload_json string, published_year int")
    assert rows.select(E.row_checks(F.col("payload_json"), F.col("published_year"), 2026).alias("c")).first().c == checks


def test_counts_keep_checks_without_failures(spark):
    rows = spark.createDataFrame([("u", "{"), ("v", json.dumps(GOOD)), ("w", "[")], "url string, payload_json string").withColumn("published_year", F.lit(2010))
    failing = E.issues(rows, 2026)
    assert {r.check: r.n for r in E.issue_counts(failing).collect()} == dict.fromkeys(E.CHECKS, 0) | {"invalid_json": 2}
    assert [r.url for r in E.listed_issues(failing, 1).collect()] == ["u"] and E.listed_issues(failing, 0).count() == 0 and E.listed_issues(failing, None).count() == 2


def test_metadata(spark):
    pages = [("u", '<iframe src="https://youtu.be/abcdefghijk"></iframe><a href="https://www.nicovideo.jp/watch/sm9">x</a>'), ("v", '<a href="https://youtu.be/abcdefghijk">x</a>'), ("w", "")]
    details = P.details(spark.createDataFrame(pages, "url string, html string")).union(spark.createDataFrame([("bad", "{", None), ("odd", '{"videos": 3}', None)], "url string, payload_json string, published_year int"))
    ids = E.video_ids(details)
    assert sorted(tuple(r) for r in ids.collect()) == [("niconico", "sm9"), ("youtube", "abcdefghijk")]
    answers = spark.createDataFrame([("youtube", "abcdefghijk", '{"title": "T", "thumbnail_url": "http://t"}'), ("niconico", "sm9", "<broken"), ("youtube", "zzzzzzzzzzz", None)], "service string, id string, body string")
    metadata = answers.withColumn("r", E.answer("service", "id", "body")).filter("body IS NOT NULL").select("service", "id", "r.*")
    assert sorted(tuple(r) for r in E.fetch_summary(ids, metadata).collect()) == [("niconico", 1, 0, 0, 1), ("youtube", 1, 1, 0, 0)]
    got = {r.url: r for r in E.apply_metadata(details, metadata).collect()}
    assert {u: r.updated for u, r in got.items()} == {"u": 2, "v": 1, "w": 0, "bad": 0, "odd": 0} and got["bad"].payload_json == "{"
    u = json.loads(got["u"].payload_json)
    entry = u["videos"]["youtube"][0]
    assert (entry["title"], entry["thumbnail_url"], len(entry["thumbnail_urls"])) == ("T", "http://t", 5) and u["published_year"] is None
    assert u["related_videos"]["niconico"][0]["title"] == "ニコニコ動画"


def test_metadata_are_merged_however_small_they_seem(spark, tmp_path, capsys):
    """Files tell sizes, so that these tables would be broadcast by their estimates."""
    spark.createDataFrame([("u", '{"videos": {"youtube": [{"id": "a"}]}}')], "url string, payload_json string").write.parquet(str(tmp_path / "details"))
    spark.createDataFrame([("youtube", "a", "T", "http://t")], "service string, id string, title string, thumbnail_url string").write.parquet(str(tmp_path / "metadata"))
    details, metadata = (spark.read.parquet(str(tmp_path / t)) for t in ("details", "metadata"))
    for df in (E.fetch_summary(E.video_ids(details), metadata), E.apply_metadata(details, metadata)):
        df.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin [service" in plan and "Broadcast" not in plan


def test_store_report(spark):
    names = "songs details with_year with_composer orphan_details orphan_people invalid version_mismatch videos with_thumbnail"
    counts = spark.createDataFrame([(2, 1, 0, 1, 1, 0, 0, 3, 2, 0)], ", ".join(f"{x} long" for x in names.split()))
    metadata = spark.createDataFrame([("song_count", "3"), ("schema", "1"), ("detail_count", "x")], "key string, value string")
    r = E.store_report(counts, metadata, ("song_count", "built_at"), {"schema": "2"}).first()
    assert not r.ok and r.warnings == ["no record has a year", "no video has a thumbnail"]
    assert r.errors == ["metadata lacks built_at", "schema is 1, not 2", "song_count is 3 but there are 2", "detail_count is x but there are 1", "2 songs but 1 details", "1 details without a song", "3 details of another version"]
    good = spark.createDataFrame([(1, 1, 1, 1, 0, 0, 0, 0, 0, 0)], counts.schema)
    assert E.store_report(good, metadata.filter("false"), (), {}).first().ok


def test_written_report(spark, tmp_path):
    E.written_report(spark.createDataFrame([("曲", None)], "a string, b int"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"a":"曲","b":null}'


def test_thumbnails_after_failures(spark):
    row = spark.createDataFrame([((["a", "b"], "s"), ([], "s"))], "x struct<thumbnail_urls: array<string>, thumbnail_url: string>, y struct<thumbnail_urls: array<string>, thumbnail_url: string>")
    r = row.select(P.thumbnail(F.col("x")), P.thumbnail(F.col("x"), 1), P.thumbnail(F.col("x"), 2), P.thumbnail(F.col("y")), P.thumbnail(F.col("y"), 1)).first()
    assert tuple(r) == ("a", "b", None, "s", None)
