"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs, word triples and
pairs with one word skipped.  Training runs FTRL-proximal with per-coordinate
learning rates and L1 regularisation over a bounded sample of labelled
documents (``SAMPLE`` rows, the smallest by a hash of the id), in one task, as
averaging the weights of shards was measured to lose recall.  The L1 term
leaves some hundred non-zero weights, broadcast as one small table whose size
is bounded by ``2 ** BITS``.

Defined cases: null and empty texts have no features and get the bias; a very
long text is read whole, as a slice of its own; labels that are null or of
absent documents are ignored; repeated rows are scored alike; a null id is held
out (its text is empty, and crc32 of that is 0); without training labels every
score is 0.5; an empty table gives an empty result; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import fold_of, table

BITS = 20
#: Labelled rows to learn from at most; documents learned from are whole.
SAMPLE = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0
#: Times that an example of label 1, the rarer one, is learned in each epoch.
POSITIVE = 2
#: Word offsets of each feature kind: words, pairs, triples, pairs with one word skipped.
GRAMS = ((0,), (0, 1), (0, 1, 2), (0, 2))
THRESHOLD = 0.5


def hashed(h: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, document) arrays of each kind, repeats included."""
    out = []
    for kind, steps in enumerate(GRAMS):
        g = V.combine(h, len(steps), steps) if len(steps) > 1 else h
        d = doc[: len(g)]
        ok = d == doc[steps[-1] :] if len(g) else np.zeros(0, bool)
        with np.errstate(over="ignore"):
            f = (g + np.uint64(kind) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        out.append((f[ok].astype(np.int64), d[ok]))
    return out


def words(texts: pa.Array):
    for i, j, buf, off in V.slices(texts):
        low = V.LOWER[buf]
        s, e, doc = V.runs(low, off, V.WORD)
        yield i, j, V.Hasher(low).spans(s, e), doc


def features(texts: pa.Array) -> list[np.ndarray]:
    """Distinct features of each text, sorted."""
    out = []
    for i, j, h, doc in words(texts):
        f, d = (np.concatenate(x) for x in zip(*hashed(h, doc)))
        both = np.unique((d << BITS) | f)
        bound = np.searchsorted(both, np.arange(j - i + 1) << BITS)
        out += [(both[bound[k] : bound[k + 1]] & ((1 << BITS) - 1)).astype(np.int32) for k in range(j - i)]
    return out


class Ftrl:
    """FTRL-proximal state; coordinate 2**BITS is the bias, which L1 leaves alone."""

    def __init__(self):
        size = (1 << BITS) + 1
        self.n, self.z = np.zeros(size), np.zeros(size)
        self.l1 = np.full(size, L1)
        self.l1[-1] = 0

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, l1 = self.z[i], self.l1[i]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2))

    def learn(self, i: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        new = self.n[i] + g * g
        self.z[i] += g - (np.sqrt(new) - np.sqrt(self.n[i])) / ALPHA * w
        self.n[i] = new


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero weights: their features and values."""
    y = F.col(label).cast("int")
    chosen = labels.filter(y.isin(0, 1)).select("doc_id", y.alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)  # a bounded number of ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([x.tobytes() for x in features(b.column("text"))], pa.binary())], names=["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    examples = rows.mapInArrow(extract, f"doc_id {kind}, y int, x binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "y", "x")  # at most the sample

    def train(batches):
        xs, ys = [], []
        for b in batches:
            xs += [np.append(np.frombuffer(x, np.int32), np.int32(1 << BITS)) for x in b.column("x").to_pylist()]
            ys += b.column("y").to_pylist()
        state, rng = Ftrl(), np.random.Generator(np.random.PCG64(7))
        for _ in range(EPOCHS):
            for r in rng.permutation(len(xs)):
                for _ in range(POSITIVE if ys[r] else 1):
                    state.learn(xs[r], ys[r])
        w = state.weights(slice(None))
        i = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w[i])], names=["i", "w"])

    got = examples.mapInArrow(train, "i long, w double").toArrow()  # at most 2**BITS + 1 rows
    return got.column("i").to_numpy(), got.column("w").to_numpy()


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w = np.zeros((1 << BITS) + 1)
        w[shared.value[0]] = shared.value[1]
        live = w != 0
        for b in batches:
            total = np.full(b.num_rows, w[-1])
            for i, j, h, doc in words(b.column("text")):
                got = [(f[k], d[k]) for f, d in hashed(h, doc) for k in [live[f]]]
                f, d = (np.concatenate(x) for x in zip(*got))
                both = np.unique((d << BITS) | f)
                total[i:j] += np.bincount(both >> BITS, w[both & ((1 << BITS) - 1)], minlength=j - i)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))], names=[*keep, "score"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, fields + "score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scores(docs, fit(docs, labels.filter(fold_of() != 0)))
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
