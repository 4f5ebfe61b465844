"""Benchmark decontamination with suffix arrays of the training documents.

Each slice of documents is a shard.  Its word sequence gets a suffix array,
held only for suffixes whose first words start some test suffix (any other
suffix has an empty interval for every test suffix, so nothing is lost), and
every test suffix is binary-searched in it.  The interval found lists the exact
places of the match; places on one diagonal join into the longest verbatim
matches.  Documents whose matches cover enough of their words are removed.

The test side is broadcast in blocks of at most ``BLOCK_BYTES`` of benchmark
text: a larger benchmark takes more passes over the documents, never a larger
broadcast.  Nothing about the documents is shuffled in a single-block run.

Words are compared by 64-bit hashes of their bytes.

Defined cases: a null or empty text has no words, matches nothing and is clean;
an item without words is never found; an item of fewer words than a window is
one window of all its words; a very long text is searched whole, as a shard of
its own; repeated rows of documents are judged one by one, whatever their ids;
items with equal ids count once if any of their texts occurs, and those without
an id hit words but are not listed; an empty benchmark hits nothing and an
empty table gives an empty result; extra columns, whatever their names, are
kept by :func:`decontaminate` and ignored by the others.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import free, table, written

WINDOW = 13
BLOCK_BYTES = 8_000_000
#: First words that a suffix must share with a test suffix to enter the array.
SEED = 2


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row) by slice of the column."""
    for i, j, buf, off in V.slices(texts):
        low = V.LOWER[buf]
        s, e, doc = V.runs(low, off, V.WORD)
        yield i, j, V.Hasher(low).spans(s, e), V.per_doc(doc, j - i)


class Tests:
    """The windows of one block of benchmark items, by length, sorted by their words."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        self.ids, self.window = [None if x is None else str(x) for x in ids], window
        item, at, rows = [], [], []
        for i, j, h, first in words_of(pa.array(texts, pa.large_string())):
            for k in range(i, j):
                w = h[first[k - i] : first[k - i + 1]]
                n = min(len(w), window)
                for p in range(len(w) - n + 1 if n else 0):
                    item.append(k)
                    at.append(p)
                    rows.append(w[p : p + n])
        #: by length: items, places, beginnings of suffixes, words, and the windows as ranks of words
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for n in sorted({len(r) for r in rows}):
            k = [x for x, r in enumerate(rows) if len(r) == n]
            tests = np.stack([rows[x] for x in k])
            known = np.unique(V.combine(tests.ravel(), min(SEED, n))[np.arange(len(tests)) * n])
            alphabet = np.unique(tests)
            wanted = _rows(np.searchsorted(alphabet, tests).astype(np.int64))
            self.by_length[n] = np.array([item[x] for x in k]), np.array([at[x] for x in k]), known, alphabet, wanted

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, place in the document, place in the item, words) of each occurrence of a window."""
        out = [np.zeros((5, 0), np.int64)]
        for n, (item, at, known, alphabet, wanted) in self.by_length.items():
            ok = np.flatnonzero(V.cuts(len(h), first, n))
            if not len(ok):
                continue
            # suffixes that begin as some test suffix does
            seed = min(SEED, n)
            starts = V.combine(h, seed)[ok]
            ok = ok[known[np.minimum(np.searchsorted(known, starts), len(known) - 1)] == starts]
            if not len(ok):
                continue
            # ranks keep the order of words and make each suffix a row of small numbers
            suffix = h[ok[:, None] + np.arange(n)]
            rank = np.searchsorted(alphabet, suffix).astype(np.int64)
            strange = alphabet[np.minimum(rank, len(alphabet) - 1)] != suffix
            rank[strange] = len(alphabet)  # no test word: such a suffix sorts apart from every test
            keep = ~strange.any(1)
            rank, ok = rank[keep], ok[keep]
            if not len(ok):
                continue
            order = np.lexsort(rank.T[::-1])
            array, places = _rows(rank[order]), ok[order]
            lo, hi = np.searchsorted(array, wanted, "left"), np.searchsorted(array, wanted, "right")
            count = hi - lo
            which = np.repeat(np.arange(len(wanted)), count)
            place = places[np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
            doc = np.searchsorted(first, place, "right") - 1
            out.append(np.stack([doc, item[which], place, at[which], np.full(len(place), n)]))
        return tuple(np.concatenate(out, 1))


def _rows(rank: np.ndarray) -> np.ndarray:
    """Rows of ranks as byte strings in the rows' own order; ranks end in a byte 1, as numpy drops trailing zeros."""
    x = (rank.astype(np.uint64) << np.uint64(8)) | np.uint64(1)
    return np.ascontiguousarray(x.astype(">u8")).view(f"S{8 * rank.shape[1]}").ravel()


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """Benchmark items in blocks of bounded bytes, streamed to the driver one at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len((r[1] or "").encode())
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _hits(shared, window: int):
    def run(batches):
        tests = Tests(*shared.value, window)
        for b in batches:
            n_words, spans, items = [], [], []
            for i, j, h, first in words_of(b.column("text")):
                doc, item, place, _, n = tests.search(h, first)
                order = np.argsort(doc, kind="stable")
                bound = np.searchsorted(doc[order], np.arange(j - i + 1))
                n_words += np.diff(first).tolist()
                for k in range(j - i):
                    own = order[bound[k] : bound[k + 1]]
                    if not len(own):
                        spans.append([])
                        items.append([])
                        continue
                    spans.append(merged(place[own] - first[k], place[own] - first[k] + n[own]))
                    items.append(sorted({tests.ids[x] for x in item[own].tolist()} - {None}))
            yield pa.RecordBatch.from_arrays(
                [*(c for name, c in zip(b.schema.names, b.columns) if name != "text"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                names=[*(x for x in b.schema.names if x != "text"), "n_words", "spans", "items"],
            )

    return run


def merged(start: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """Union of half-open intervals, as sorted pairs."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, s[1:] > e[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]
    return np.stack([s[new], e[last]], 1).tolist()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the columns ``keep``, n_words, spans (hit word intervals) and items (ids whose windows occur).

    With several benchmark blocks the documents are stored with row numbers, by which the passes are merged.
    """
    first, rest = _first(benchmark, block_bytes)
    if rest is None:
        return _pass(docs, docs.sparkSession.sparkContext.broadcast(first), window, keep)
    rows, row = _numbered(docs.select(*keep, "text"))
    return _merged(rows, row, itertools.chain([first], rest), window, keep).drop(row)


def _first(benchmark: DataFrame, block_bytes: int) -> tuple[tuple[list, list], Iterator[tuple[list, list]] | None]:
    """The first block of the benchmark, which may be empty, and the others if there are any."""
    some = blocks(benchmark, block_bytes)
    first, second = next(some, ([], [])), next(some, None)
    return first, None if second is None else itertools.chain([second], some)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Stored rows with a number each, the same in every pass, and the name of that column."""
    row = free("_row", docs.columns)
    return written(docs.withColumn(row, F.monotonically_increasing_id())), row


def _pass(docs: DataFrame, shared, window: int, keep: tuple[str, ...]) -> DataFrame:
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    schema = f"{fields}, n_words long, spans array<array<long>>, items array<string>"
    return docs.select(*keep, "text").mapInArrow(_hits(shared, window), schema)


def _merged(rows: DataFrame, row: str, some: Iterable[tuple[list, list]], window: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The row number, ``keep``, n_words, spans and items over all blocks; one block is broadcast at a time."""
    every = None
    for block in some:
        shared = rows.sparkSession.sparkContext.broadcast(block)
        p = written(_pass(rows, shared, window, (row, *keep)))
        shared.unpersist()
        every = p if every is None else every.unionByName(p)
    kept = [F.first(c).alias(c) for c in keep]
    every = every.groupBy(row).agg(*kept, F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    join = F.expr(
        "aggregate(array_sort(spans), cast(array() as array<array<long>>), (acc, x) -> "
        "if(size(acc) > 0 and element_at(acc, -1)[1] >= x[0], "
        "concat(slice(acc, 1, size(acc) - 1), array(array(element_at(acc, -1)[0], greatest(element_at(acc, -1)[1], x[1])))), "
        "concat(acc, array(x))))"
    )
    return every.withColumn("spans", join)


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim matches of at least a window: doc_id, item_id (as text), doc_word, item_word, n_words."""
    spark = docs.sparkSession

    def finder(ids, texts):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches):
            tests = Tests(*shared.value, window)
            for b in batches:
                key, out = b.column("doc_id"), [[], [], [], [], []]
                for i, _, h, first in words_of(b.column("text")):
                    doc, item, place, at, n = tests.search(h, first)
                    order = np.lexsort((place, place - at, item, doc))
                    doc, item, place, at, n = (x[order] for x in (doc, item, place, at, n))
                    if not len(doc):
                        continue
                    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - at[1:] != place[:-1] - at[:-1]) | (place[1:] != place[:-1] + 1)]
                    last = np.r_[np.flatnonzero(new)[1:] - 1, len(doc) - 1]
                    for d, t, p, a, m in zip(doc[new], item[new], place[new], at[new], place[last] + n[last] - place[new]):
                        for c, x in zip(out, (key[i + int(d)].as_py(), tests.ids[t], int(p - first[d]), int(a), int(m))):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field("doc_id").type), pa.array(out[1], pa.string()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id string, doc_word long, item_word long, n_words long"
    every = None
    for ids, texts in blocks(benchmark, block_bytes):
        p = docs.select("doc_id", "text").mapInArrow(finder(ids, texts), schema)
        every = p if every is None else every.unionByName(p)
    return spark.createDataFrame([], schema) if every is None else every


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with their own columns, without contaminated documents."""
    first, rest = _first(benchmark, block_bytes)
    if rest is not None:  # hits of all blocks are judged together
        rows, row = _numbered(docs)
        bad = judged(_merged(rows, row, itertools.chain([first], rest), window)).filter("contaminated").select(row)
        return rows.join(bad, row, "left_anti").select(*docs.columns)
    tests_of = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches):
        tests = Tests(*tests_of.value, window)
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, j, h, first in words_of(b.column("text")):
                doc, _, place, _, n = tests.search(h, first)
                order = np.argsort(doc, kind="stable")
                bound = np.searchsorted(doc[order], np.arange(j - i + 1))
                for k in np.flatnonzero(np.diff(bound)):
                    own = order[bound[k] : bound[k + 1]]
                    hit = sum(e - s for s, e in merged(place[own], place[own] + n[own]))
                    keep[i + k] = not (20 * hit >= first[k + 1] - first[k])
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH dw AS (
  SELECT doc_id, w, len(w) AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
bw AS (
  SELECT item_id, w, least(len(w), 13) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM bw)),
ks AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (
    SELECT doc_id, w, k, unnest(range(1, n - k + 2)) AS p FROM dw, ks WHERE n >= k)),
found AS (SELECT doc_id, item_id, p, k FROM grams JOIN windows USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
