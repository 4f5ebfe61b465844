"""Dumps with keys and references, loaded by SQLite with its foreign keys on."""

import sqlite3

import pytest

from quaver.operators import store
from quaver.operators.store import Reference

SONGS = "song_url string, title string, score double"
KEYS = {"songs": (("song_url",), ("title",)), "details": (("url",),), "people": (("song_url", "role", "name"),)}
REFERENCES = {"details": (Reference(("url",), "songs", ("song_url",)),), "people": (Reference(("song_url",), "songs", ("song_url",)), Reference(("main",), "people2", ("id",)))}


def tables(spark, songs=(), details=(), people=()):
    return {
        "people": spark.createDataFrame([("a", "composer", "x", None), ("a", "vocalist", "x", 1), *people], "song_url string, role string, name string, main int"),
        "people2": spark.createDataFrame([(1, None), (2, 1), (3, 3)], "id int, over int"),
        "details": spark.createDataFrame([("a", "it's", True), *details], "url string, note string, flag boolean"),
        "songs": spark.createDataFrame([("a", "A", 0.5), ("b", "B\nb", None), *songs], SONGS),
    }


def dumped(t, **how):
    keys, references = KEYS | {"people2": (("id",),)}, REFERENCES | {"people2": (Reference(("over",), "people2", ("id",)),)}
    return [r.statement for r in store.dump(t, keys=keys, references=references, **how).orderBy("step").collect()]


def test_loads_with_foreign_keys_on(spark):
    lines = dumped(tables(spark), indexes={"by_role": ("people", ("role",))})
    con = sqlite3.connect(":memory:")
    con.execute("PRAGMA foreign_keys = ON")
    for _ in range(2):  # the second time drops what refers to others first
        for line in lines:
            con.execute(line)
    assert con.execute("PRAGMA foreign_key_check").fetchall() == [] and con.execute("PRAGMA integrity_check").fetchone() == ("ok",)
    assert con.execute("SELECT * FROM songs ORDER BY 1").fetchall() == [("a", "A", 0.5), ("b", "B\nb", None)]
    assert con.execute("SELECT * FROM details").fetchall() == [("a", "it's", 1)]
    with pytest.raises(sqlite3.IntegrityError):
        con.execute("INSERT INTO details VALUES ('none', '', 0)")
    con.execute("DELETE FROM songs WHERE song_url = 'a'")
    assert con.execute("SELECT count(*) FROM people").fetchone() == (0,)


@pytest.mark.parametrize(
    "rows, said",
    [
        ({"songs": [("a", "again", 1.0)]}, r'songs: repeated key \{"song_url":"a"\} \(2 rows\)'),
        ({"songs": [(None, "null", 1.0)]}, r'songs: null in key \{"song_url":null\} \(1 rows\)'),
        ({"details": [("c", "", False)]}, r'details: no such row of songs \{"url":"c"\} \(1 rows\)'),
        ({"people": [("a", "arranger", "y", 9), ("b", "arranger", "y", 9)]}, r'people: no such row of people2 \{"main":9\} \(2 rows\)'),
    ],
)
def test_broken_rows_are_told(spark, rows, said):
    with pytest.raises(ValueError, match=said):
        dumped(tables(spark, **rows))


def test_orders_and_circles():
    r = lambda t: (Reference(("x",), t, ("k",)),)
    assert store.dependent_order(["c", "b", "a", "d"], {"c": r("b"), "b": r("a"), "d": r("d")}) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="go round"):
        store.dependent_order(["a", "b"], {"a": r("b"), "b": r("a")})
    with pytest.raises(ValueError, match="out of the dump"):
        store.dependent_order(["a"], {"a": r("b")})
