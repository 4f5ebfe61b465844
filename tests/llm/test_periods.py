"""Periodic runs against a plain version of their rules."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaver.llm import periods

DATA = "/root/testdata/sf0.001"


def plain_runs(w):
    """Every lag scanned; the smallest period of each stretch tried from 1 upwards."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and not any(w[i + d : i + length] == w[i : i + length - d] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
        sha(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_whole_query(spark):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    wanted = [plain_row(*r) for r in docs if len((r[1] or "").split()) < 3000]
    known = {r[0] for r in wanted}
    got = sorted(tuple(r) for r in periods.op11_periods(spark, DATA).collect())
    assert len(got) == len(docs)
    assert [r for r in got if r[0] in known] == wanted
    assert sum(r[1] > 0 for r in wanted) > 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=14), st.integers(1, 12)), max_size=6))
def test_runs_of_generated_texts(parts):
    w = [x.encode() for block, times in parts for x in block * times]
    assert periods.runs_of([w]) == [plain_runs(w)]


@pytest.mark.parametrize("heavy", [0, 1, 3, 10, 10**6])
def test_counts_do_not_depend_on_what_is_frequent(heavy):
    rng = random.Random(heavy)
    texts = [[rng.choice("aaabcdefgh").encode() for _ in range(n)] for n in (0, 1, 30, 257, 999)]
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    word = np.concatenate([periods.numbered(t, 100 * k) for k, t in enumerate(texts)])
    got = periods.lag_matches(word, off, heavy)
    for t, o in zip(texts, off.tolist()):
        for lag in range(1, len(t) // 3 + 1):
            assert got[o + lag] == sum(x == y for x, y in zip(t, t[lag:]))


def test_overlapping_runs_and_multiples():
    """A run beside one of a multiple of its period, and runs that share words."""
    a, b = [b"a"] * 40, [*b"b c".split()]
    w = a + b * 20 + [b"x"] + (a[:5] + b) * 9 + a
    assert periods.runs_of([w]) == [plain_runs(w)]


def test_very_long_texts():
    """One word over and over, and words at random with a run in their midst: both in seconds."""
    rng = np.random.default_rng(1)
    one = [b"la"] * 400_000
    prose = [b"w%d" % x for x in np.minimum(rng.zipf(1.3, 200_000), 5000)]
    prose[100_000:101_000] = [b"p%d" % (k % 250) for k in range(1000)]
    first, second = periods.runs_of([one, prose])
    assert first == [(0, 400_000, 1)]
    assert (100_000, 1000, 250) in second


def test_edges(spark):
    again = "one two three " * 8
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, again), (4, again), (None, again + "tail"), (None, None), (5, "é ü\x0b" * 30), (6, "word " * 23), (7, "word " * 24), (8, "a b " * 24)]
    schema = "doc_id long, text string, runs string, collapsed string, words string, strongest string, start string"
    from quaver.llm import periods as op

    docs = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], schema)
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in op.periodic_runs(docs).collect()}
    for i, t in rows:
        w = (t or "").encode().split()
        runs = plain_runs(w)
        assert (i, len(w), tuple(runs), op.collapsed(w, runs).decode()) in got
    assert op.periodic_runs(docs.limit(0)).collect() == []
    edited = docs.select("doc_id", op.cycled(docs["doc_id"], docs["text"]).alias("text")).collect()
    for r in edited:
        if zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 10:
            assert (r.doc_id, r.text) in rows
