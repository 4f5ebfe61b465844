"""Phrase collocations of each language, from exact counts.

1. Texts are cut into pieces, pieces into words.  Equal pieces become one with a
   multiplicity: within a slice first, then by a shuffle.
2. Words, pairs, and phrases of three and four words are counted in three passes
   over the distinct pieces.  A slice adds up its own grams, cuts them by hash
   bucket and sends each bucket's share as one compressed block; the task of a
   bucket adds up its blocks in duckdb, which spills beyond ``DUCK_MEMORY``.  A
   gram is worth counting only if all of its parts are frequent, so a pass skips
   what a bit table of the frequent grams before it excludes.  The table has
   ``BITS`` bits whatever the corpus: where it fills up, more is counted and
   thrown away, and the result is the same.
3. Every cut of a candidate asks for the counts of both parts.  The requests are
   shuffled to the counts, and the answers back to their candidate.
4. A candidate that a longer one mostly explains is dropped; the rest is ranked
   in each language, by salted shares before the whole.

Defined cases: a null text counts as empty and adds nothing; a null lang is
``und``; repeated rows and equal texts count each time; phrases of the same
score and count rank by their UTF-8 bytes; a very long text or piece is counted
whole; a language without candidates has no rows; an empty table gives an empty
result; extra columns, whatever their names, are ignored.  Grams are known by
64-bit hashes within a slice, and by their text everywhere else.
"""

from __future__ import annotations

import os
import tempfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _vec as V
from ._common import parts, table, written

LONGEST, LEAST, COVER, TOP = 4, 30, 80, 2000
#: Bytes of text whose grams are added up at once.
TOGETHER = 2_000_000
#: Words of distinct pieces for one hash bucket, and what duckdb may hold of it in memory.
BUCKET_WORDS, DUCK_MEMORY = 20_000_000, "192MB"
#: Shares of a language that are ranked side by side; the last ranking sees as many times the rows that it keeps.
SHARES = 64
#: Bits of the table of frequent grams.
BITS = 1 << 26
_ENDS = V.byte_class(False, on=b".,;:!?\x0a\x0b\x0c\x0d")
_LETTERS = V.byte_class(True, off=b"\x20\x09.,;:!?\x0a\x0b\x0c\x0d")
_SPACED = V.byte_class(True, off=b"\x20")


def gathered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these spans one after another, and the length of each."""
    size = end - start
    first = np.cumsum(size) - size
    return buf[np.arange(int(size.sum())) + np.repeat(start - first, size)], size


def strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def pieces_of(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces of a slice of texts (each word followed by one space), their numbers of words, and how often each occurs."""
    low = np.insert(V.LOWER[buf], off[1:], 10)  # a text ends a piece
    s, e, _ = V.runs(low, np.array([0, len(low)]), _LETTERS)
    if not len(s):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(_ENDS[low])
    first = np.flatnonzero(np.r_[True, ends[s[1:]] != ends[s[:-1]]])
    data, size = gathered(low, s, e + 1)
    at = np.cumsum(size)
    data[at - 1] = 32
    start = (at - size)[first]
    end = np.r_[start[1:], len(data)]
    words = np.diff(np.r_[first, len(s)])
    _, one, count = np.unique(V.Hasher(data).spans(start, end), return_index=True, return_counts=True)
    return strings(*gathered(data, start[one], end[one])), words[one], count


def _cut(batches):
    """Batches of (lang, text) to distinct pieces with multiplicities."""
    for b in batches:
        langs = b.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = b.column("text").filter(pa.array(langs.indices.to_numpy(zero_copy_only=False) == k))
            for _, _, buf, off in V.slices(own, TOGETHER):
                text, words, count = pieces_of(buf, off)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), text.cast(pa.string()), pa.array(words), pa.array(count)], names=["lang", "piece", "words", "m"])


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, words, m): every distinct piece with its number of words and its multiplicity."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_cut, "lang string, piece string, words long, m long").groupBy("lang", "piece").agg(F.first("words").alias("words"), F.sum("m").alias("m"))


def _tongue(lang: str) -> np.uint64:
    return V.mix(np.array([zlib.crc32(lang.encode())], np.uint64))[0]


def places(h: np.ndarray, lang: str) -> np.ndarray:
    """Where gram hashes of a language are in the bit table."""
    return (V.mix(h ^ _tongue(lang)) % np.uint64(BITS)).astype(np.int64)


class Frequent:
    """A bit table of frequent grams; no frequent gram is missing, others may seem to be there."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, h: np.ndarray, lang: str) -> np.ndarray:
        at = places(h, lang)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def grams_of(buf: np.ndarray, off: np.ndarray, m: np.ndarray, lang: str, sizes: tuple[int, ...], known: Frequent | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, start, end, weight) of the distinct grams of each size in pieces with multiplicities; ``known`` tells which parts are frequent."""
    s, e, piece = V.runs(buf, off, _SPACED)
    h = V.Hasher(buf).spans(s, e)
    out = []
    if known is not None:
        base = min(sizes) - 1  # the size of the parts that are looked up
        part = known(V.combine(h, base) if base > 1 else h, lang)
    for k in sizes:
        g = V.combine(h, k) if k > 1 else h
        good = piece[: len(g)] == piece[k - 1 : k - 1 + len(g)]
        if known is not None:
            for j in range(k - base + 1):
                good &= part[j : j + len(g)]
        at = np.flatnonzero(good)
        value, one, back = np.unique(g[at], return_index=True, return_inverse=True)
        first = at[one]
        out.append((value, s[first], e[first + k - 1], np.bincount(back, m[piece[at]], len(value)).astype(np.int64)))
    return out


def block(data: np.ndarray, size: np.ndarray, weight: np.ndarray) -> bytes:
    raw = b"".join([np.array([len(size)], "<i8").tobytes(), size.astype("<i4").tobytes(), weight.astype("<i8").tobytes(), data.tobytes()])
    return zstandard.compress(raw, 1)


def opened(raw: bytes) -> tuple[pa.Array, pa.Array]:
    """The grams and weights of a block."""
    raw = zstandard.decompress(raw)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return strings(np.frombuffer(raw, np.uint8, offset=8 + 12 * n), np.frombuffer(raw, "<i4", n, 8).astype(np.int64)), pa.array(np.frombuffer(raw, "<i8", n, 8 + 4 * n))


def _sent(sizes: tuple[int, ...], shared, buckets: int):
    """Batches of pieces to one block for each language and bucket of every TOGETHER bytes."""

    def blocks(t: pa.Table, known):
        langs = t.column("lang").combine_chunks().dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = t.filter(pa.array(langs.indices.to_numpy(zero_copy_only=False) == k))
            m = own.column("m").to_numpy()
            for i, j, buf, off in V.slices(own.column("piece"), TOGETHER):
                for h, s, e, weight in grams_of(buf, off, m[i:j], lang, sizes, known):
                    bucket = (V.mix(h) >> np.uint64(20)) % np.uint64(buckets)
                    order = np.argsort(bucket, kind="stable")
                    data, size = gathered(buf, s[order], e[order])
                    weight, byte = weight[order], np.r_[0, np.cumsum(size)]
                    some, first = np.unique(bucket[order], return_index=True)
                    for x, a, z in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                        yield x, lang, block(data[byte[a] : byte[z]], size[a:z], weight[a:z])

    def batch(rows):
        b, lang, raw = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(lang, pa.string()), pa.array(raw, pa.binary())], names=["bucket", "lang", "block"])

    def run(batches):
        known = shared and Frequent(shared.value)
        held, size, rows, out = [], 0, [], 0

        def flushed():
            return blocks(pa.Table.from_batches(held), known) if held else ()

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= TOGETHER:
                for r in flushed():
                    rows.append(r)
                    out += len(r[2])
                    if out > TOGETHER:
                        yield batch(rows)
                        rows, out = [], 0
                held, size = [], 0
        rows += flushed()
        yield batch(rows)

    return run


def _added(least: int):
    """The blocks of one hash bucket, added up in duckdb; grams that occur less than ``least`` times go."""

    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("gram", pa.large_string()), ("w", pa.int64())])

        def rows():
            for b in batches:
                for lang, raw in zip(b.column("lang").to_pylist(), b.column("block").to_pylist()):
                    gram, w = opened(raw)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w), pa.string()), gram, w], schema=schema)

        # duckdb spills where Spark itself does: into the task's local folders, which end with the application
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.TemporaryDirectory(dir=local) as spill, duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": spill}) as con:
            con.register("blocks", pa.RecordBatchReader.from_batches(schema, rows()))
            for b in con.sql(f"SELECT lang, gram, sum(w)::BIGINT AS f FROM blocks GROUP BY lang, gram HAVING sum(w) >= {least:d}").to_arrow_reader(10_000):
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), b.column(2)], names=["lang", "gram", "f"])

    return run


def _hashed(size: int):
    def run(batches):
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = b.column("gram").filter(pa.array(langs.indices.to_numpy(zero_copy_only=False) == k))
                for _, _, buf, off in V.slices(own):
                    s, e, _ = V.runs(buf, off, _SPACED)
                    h = V.Hasher(buf).spans(s, e)
                    at = places(V.combine(h, size)[::size] if size > 1 else h, lang)
                    yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bit"])

    return run


def frequent(grams: DataFrame, size: int) -> np.ndarray:
    """The bit table of these grams, all of one size: BITS / 8 bytes."""
    bits = grams.mapInArrow(_hashed(size), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    return out.view(np.uint64)


def counted(pieces: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """Tables (lang, gram, f) of the grams that occur at least ``least`` times: words, pairs, and the longer ones together."""
    spark = pieces.sparkSession
    total = pieces.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    buckets = max(2 * parts(spark), -(-total // BUCKET_WORDS))

    def count(sizes, shared):
        sent = pieces.select("lang", "piece", "m").mapInArrow(_sent(sizes, shared, buckets), "bucket int, lang string, block binary")
        return written(sent.repartitionById(buckets, F.col("bucket")).select("lang", "block").mapInArrow(_added(least), "lang string, gram string, f long"))

    out, shared = [count((1,), None)], None
    for sizes in ((2,), tuple(range(3, longest + 1))):
        if sizes:
            shared = spark.sparkContext.broadcast(frequent(out[-1], sizes[0] - 1))
            out.append(count(sizes, shared))
            shared.unpersist()
    return out


def _scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Each candidate with l, r and score of its lowest-scoring cut."""
    joined = lambda words, a, n: F.array_join(F.slice(words, a, n), " ")
    words = F.split("phrase", " ")
    size = F.size(words)
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(F.struct(k.alias("cut"), F.lit(0).alias("side"), joined(words, 1, k).alias("gram")), F.struct(k.alias("cut"), F.lit(1).alias("side"), joined(words, k + 1, size - k).alias("gram"))))
    requests = candidates.select("lang", "phrase", "a", F.explode(F.flatten(cuts)).alias("z")).select("lang", "phrase", "a", "z.*")
    answers = requests.join(known, ["lang", "gram"])
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    cut = answers.groupBy("lang", "phrase", "a", "cut").agg(at(0).alias("l"), at(1).alias("r"))
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    return least.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def _explained(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, most) of every phrase inside a longer candidate: the greatest count of those."""
    words = F.split("phrase", " ")
    size = F.size(words)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    return candidates.filter(size > 2).select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first rows of each language: of salted shares first, so that no task sorts a whole language."""
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = scored.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*by))).filter(F.col("rank") <= top).drop("rank", "share")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score); see the module."""
    own = written(pieces(docs))
    words, pairs, *more = counted(own, least, longest)
    total = written(own.groupBy("lang").agg(F.sum(F.col("words") * F.col("m")).alias("n")))
    grams = pairs
    for g in more:
        grams = grams.unionByName(g)
    candidates = grams.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"))
    dropped = _explained(candidates).withColumn("most", F.col("most").cast("decimal(20,0)") * 100)
    kept = candidates.join(dropped, ["lang", "phrase"], "left").filter(F.coalesce(F.col("most") < F.col("a").cast("decimal(20,0)") * cover, F.lit(True))).select("lang", "phrase", "a")
    scored = written(_scored(kept, words.unionByName(grams)))
    ranked = _ranked(scored, top).join(total, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
gram AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
counted AS (SELECT lang, k, g, count(*) AS f FROM gram GROUP BY ALL),
cand AS (SELECT lang, k, g AS phrase, f AS a, string_split(g, ' ') AS w FROM counted WHERE k > 1 AND f >= 30),
inner_ AS (
  SELECT lang, a, unnest(list_transform(range(1, k - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS phrase
  FROM cand, (SELECT unnest([2, 3]) AS n) WHERE n < k),
kept AS (
  SELECT * FROM cand ANTI JOIN inner_ ON inner_.lang = cand.lang AND inner_.phrase = cand.phrase AND 100 * inner_.a::HUGEINT >= 80 * cand.a::HUGEINT),
cut AS (
  SELECT kept.*, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1 : k], ' ') AS y
  FROM kept, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, p.f AS l, q.f AS r, j, (2000000 * c.a::HUGEINT // (p.f::HUGEINT + q.f))::BIGINT AS score
  FROM cut c JOIN counted p ON p.lang = c.lang AND p.g = x JOIN counted q ON q.lang = c.lang AND q.g = y),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
