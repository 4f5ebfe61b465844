"""Document fingerprints by winnowing.

Every ``K`` bytes of a text get a rolling hash; of each ``W`` successive hashes
the smallest is chosen, the rightmost one on ties, and kept with its position.
Any match of at least ``W + K - 1`` bytes between two texts therefore shares a
fingerprint.  All of a slice's hashes and windows are computed together.

:func:`with_next` pairs each document with the next one in descending doc_id
without a global window: ids alone are range-partitioned to find each bucket's
largest id, and each bucket also gets a copy of the first document of the
bucket after it.  Texts cross one shuffle, compressed.

Defined cases: a null or empty text has an empty fingerprint; a text shorter
than ``K`` bytes has the hash of all its bytes; one with fewer than ``W`` grams
is one window; two empty fingerprints are alike (1.0); documents with equal ids
are ordered by a hash of their text, those without an id come last; a single
document is its own next; an empty table gives an empty result; ids are whole
numbers; a very long text is read in overlapping chunks; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import parts, table

K, W = 32, 65
_LOW = np.uint64((1 << 24) - 1)
#: Grams of one document handled at once; positions within must fit 24 bits.
_CHUNK = 1 << 23


def winnow(texts: pa.Array, k: int = K, w: int = W) -> list[tuple[np.ndarray, np.ndarray]]:
    """(40-bit hashes, byte positions) of each text, in order of position."""
    out = []
    for i, j, buf, off in V.slices(texts):
        size = np.diff(off)
        if len(buf) <= _CHUNK:
            out += _slice(buf, off, size, k, w)
        else:  # one long document: chunks overlap by a window, so each window is seen
            step = _CHUNK - w - k
            got = []
            for a in range(0, len(buf), step):
                b = min(len(buf), a + step + w + k - 2)
                h, p = _slice(buf[a:b], np.array([0, b - a]), np.array([b - a]), k, w)[0]
                got.append(np.stack([(p + a).astype(np.uint64), h]))
                if b == len(buf):
                    break
            both = np.unique(np.concatenate(got, 1), axis=1)
            out.append((both[1], both[0].astype(np.int64)))
    return out


def _slice(buf: np.ndarray, off: np.ndarray, size: np.ndarray, k: int, w: int) -> list[tuple[np.ndarray, np.ndarray]]:
    hasher = V.Hasher(buf)
    h = hasher.grams(k)
    n = len(h)
    # high bits: the hash; low bits fall with the position, so the smallest value is the rightmost smallest hash
    packed = (h & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    ok = V.cuts(n, off, k) if n else np.zeros(0, bool)
    packed[~ok] = np.uint64(2**64 - 1)
    least = V.window_min(packed, w)
    picked = np.unique(least[V.cuts(len(least), off, k + w - 1)]) if len(least) else np.zeros(0, np.uint64)
    few = np.flatnonzero((size >= k) & (size < k + w - 1))
    if len(few):
        ends = np.empty(2 * len(few), np.int64)
        ends[::2], ends[1::2] = off[few], off[few] + size[few] - k + 1
        picked = np.r_[picked, np.minimum.reduceat(np.append(packed, np.uint64(2**64 - 1)), ends)[::2]]
    place = (_LOW - (picked & _LOW)).astype(np.int64)
    value = picked >> np.uint64(24)
    tiny = np.flatnonzero((size > 0) & (size < k))
    place = np.r_[place, off[tiny]]
    value = np.r_[value, hasher.spans(off[tiny], off[tiny + 1]) >> np.uint64(24)]
    order = np.argsort(place, kind="stable")
    place, value = place[order], value[order]
    bound = np.searchsorted(place, off)
    return [(value[a:b], place[a:b] - o) for a, b, o in zip(bound[:-1].tolist(), bound[1:].tolist(), off.tolist())]


def as_text(print_: tuple[np.ndarray, np.ndarray]) -> str:
    return ",".join([f"{p}:{h:010x}" for h, p in zip(print_[0].tolist(), print_[1].tolist())])


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Jaccard likeness of the hash sets of each pair; 1 for two empty ones."""

    def keys(x):
        doc = np.repeat(np.arange(len(x)), [len(v) for v in x]).astype(np.uint64)
        return np.unique((doc << np.uint64(40)) | np.concatenate(x)) if len(doc) else np.zeros(0, np.uint64)

    ka, kb = keys(a), keys(b)
    count = lambda x: np.bincount((x >> np.uint64(40)).astype(np.int64), minlength=len(a))
    both = count(np.intersect1d(ka, kb, assume_unique=True))
    either = count(ka) + count(kb) - both
    return np.where(either == 0, 1.0, both / np.maximum(either, 1))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, hashes array<long> and positions array<long> (byte offsets) of each text."""

    def run(batches):
        for b in batches:
            got = winnow(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p for _, p in got], pa.list_(pa.int64()))], names=[*keep, "hashes", "positions"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, fields + "hashes array<long>, positions array<long>")


def with_next(docs: DataFrame, run, schema: str, buckets: int | None = None) -> DataFrame:
    """``run`` over (doc_id, text, text of the next document) triples, in lists, by bucket of descending doc_id."""
    spark = docs.sparkSession
    n = parts(spark)
    ranged = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).repartitionByRange(buckets or 4 * n, F.col("doc_id").desc())
    tops = sorted((r[0] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id")).select("max(doc_id)").collect()), reverse=True)  # one id per bucket
    shared = spark.sparkContext.broadcast(np.array(tops, np.int64))

    def deal(batches):
        top = shared.value
        press = zstandard.ZstdCompressor(level=1)
        last = max(len(top) - 1, 0)
        for b in batches:
            ids = b.column("doc_id")
            null = np.array(ids.is_null())
            x = ids.fill_null(0).to_numpy(zero_copy_only=False)
            bucket = np.where(null, last, np.searchsorted(-top, -x, "right") - 1) if len(top) else np.zeros(len(x), np.int64)
            first = ~null & (x == top[bucket]) if len(top) else np.ones(len(x), bool)
            own = np.arange(len(x))
            guest = np.flatnonzero(first)
            to = np.where(bucket[guest] == 0, last, bucket[guest] - 1)
            row = np.r_[own, guest]
            text = [press.compress((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[bucket, to]), pa.array(np.r_[np.zeros(len(own), bool), np.ones(len(guest), bool)]), ids.take(pa.array(row)), b.column("tie").take(pa.array(row)), pa.array([text[r] for r in row.tolist()], pa.binary())],
                names=["bucket", "guest", "doc_id", "tie", "z"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text").mapInArrow(deal, f"bucket long, guest boolean, doc_id {kind}, tie long, z binary")
    # a bucket is a partition: no two of them meet in one task by their hashes
    dealt = dealt.repartitionById(max(1, len(tops)), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "tie", "z")

    def paired(batches):
        open_ = zstandard.ZstdDecompressor()
        rows = ((k, g, i, z) for b in batches for k, g, i, z in zip(b.column("bucket").to_pylist(), b.column("guest").to_pylist(), b.column("doc_id").to_pylist(), b.column("z").to_pylist()))
        for _, own in itertools.groupby(rows, key=lambda r: r[0]):
            before = None
            for _, guest, i, z in own:
                text = open_.decompress(z).decode() if len(z) else ""
                if before is not None:
                    yield (*before, text)
                if guest:
                    break
                before = i, text

    def outer(batches):
        triples = paired(batches)
        while chunk := list(itertools.islice(triples, 500)):
            yield run(chunk)

    return dealt.mapInArrow(outer, schema)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The digest row of each document, its edited text and the next document."""
    kind = docs.schema["doc_id"].dataType

    def run(chunk):
        edited = []
        for _, text, after in chunk:
            cut = len(text) // 3
            edited.append(text[: len(text) - cut] + after[:cut])
        a, e, b = (winnow(pa.array(x, pa.large_string())) for x in ([c[1] for c in chunk], edited, [c[2] for c in chunk]))
        hashes = lambda x: [h for h, _ in x]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([c[0] for c in chunk], pa.int64() if kind.simpleString() == "bigint" else None),
                pa.array([len(c[1]) for c in chunk], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array([as_text(x) for x in a]),
                pa.array([as_text(x) for x in e]),
                pa.array(likeness(hashes(a), hashes(e))),
                pa.array(likeness(hashes(a), hashes(b))),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(docs, run, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
