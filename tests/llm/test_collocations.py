"""Phrase collocations against a plain version of their rules."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quaver.llm import _vec as V
from quaver.llm import collocations as op

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_pieces(text):
    for p in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
        if w := re.findall("[^\x20\x09]+", p):
            yield w


def brute(rows, least, longest, top, cover):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for w in plain_pieces(text):
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in own.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in own.items():
            if not (inside[p] and 100 * inside[p] >= cover * a):
                cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def fixture():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(12)] + ["Übel", "naïve", " x", "\x00", "\x1c"]
    rows = []
    for k in range(300):
        words = rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randrange(0, 40))
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", ". ", "\n", "!?", " ", ", "]) for w in words)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    rows += [("en", "New York City is new york city")] * 40 + [("fr", None), ("fr", ""), ("fr", ",.;"), (None, None), ("es", "la la la la la la la la la"), ("la\tng", "a b a b a b a b"), ("en", " ".join(rng.choices(vocabulary, k=30_000)))]
    return rows


@pytest.mark.parametrize("least, longest, top, cover", [(5, 4, 2000, 80), (3, 4, 7, 50), (4, 2, 2000, 80)])
def test_against_plain_counts(spark, least, longest, top, cover):
    rows = fixture()
    docs = spark.createDataFrame([(*r, *"xxxxxx") for r in rows], "lang string, text string, phrase string, gram string, f string, n string, m string, a string").repartition(6)
    got = [tuple(r) for r in op.collocations(docs, least, longest, top, cover).collect()]
    assert sorted(got) == brute(rows, least, longest, top, cover)
    assert len(got) > 10


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert op.collocations(docs).collect() == []


def test_scores_beyond_64_bits(spark):
    a = 3 * 10**12
    candidates = spark.createDataFrame([("en", "x y z", a)], "lang string, phrase string, a long")
    known = spark.createDataFrame([("en", "x", 9 * 10**18), ("en", "y z", a), ("en", "x y", a), ("en", "z", a + 1)], "lang string, gram string, f long")
    assert [tuple(r) for r in op._scored(candidates, known).collect()] == [("en", "x y z", a, 9 * 10**18, a, 2000000 * a // (9 * 10**18 + a))]


def test_buckets_are_added_up_beyond_memory(monkeypatch):
    """Many blocks of one bucket, with little memory for duckdb."""
    monkeypatch.setattr(op, "DUCK_MEMORY", "40MB")
    rng = np.random.default_rng(1)
    total, blocks = Counter(), []
    for _ in range(30):
        keys = [f"some rather long gram of four words number {k:020d}".encode() for k in rng.integers(0, 200_000, 20_000).tolist()]
        size = np.array([len(k) for k in keys])
        weight = rng.integers(1, 5, len(keys))
        for k, w in zip(keys, weight.tolist()):
            total[k.decode()] += w
        blocks.append(op.block(np.frombuffer(b"".join(keys), np.uint8), size, weight))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 30), pa.array(blocks, pa.binary())], names=["lang", "block"])
    got = {}
    for b in op._added(12)(iter([batch])):
        got |= dict(zip(b.column("gram").to_pylist(), b.column("f").to_pylist()))
    assert got == {k: w for k, w in total.items() if w >= 12} and got


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    rows = fixture()[:200]
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(op, "frequent", lambda grams, size: np.full(op.BITS // 64, 2**64 - 1, np.uint64))
    assert sorted(map(tuple, op.collocations(docs, 4).collect())) == brute(rows, 4, 4, op.TOP, op.COVER)


def test_pieces():
    texts = pa.array(["A b.a  B\tc", "", None, "a b!", "...", "É é"], pa.string())
    got = Counter()
    for _, _, buf, off in V.slices(texts):
        text, words, count = op.pieces_of(buf, off)
        for p, w, c in zip(text.to_pylist(), words.tolist(), count.tolist()):
            assert len(p.split(" ")) == w + 1
            got[p] += c
    assert got == {"a b ": 2, "a b c ": 1, "É é ": 1}


def test_sql_at_small_scale(spark):
    """The query and its SQL over documents, with their own parameters."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(map(tuple, op.op13_collocations(spark, folder).collect())) == sorted(con.execute(op.SQL).fetchall())
