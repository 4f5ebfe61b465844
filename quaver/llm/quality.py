"""Quality classifier: regularised quadratic discriminant on document statistics.

One scan turns every whole text into a few transformed statistics.  Class means
and covariances come from sums over all labelled training documents (counts,
sums and outer products add up over partitions, so the driver gets one small
row per class).  Covariances are shrunk towards the pooled covariance and its
diagonal; each class keeps its Cholesky factor, and a score is the posterior
from the difference of Mahalanobis log-densities.

Defined cases: null and empty texts have all-zero counts and get a score like
any other; a very long text is read whole, as a slice of its own; a null id is
held out (its text is empty, and crc32 of that is 0); an empty table gives an
empty result; labels that are null or of documents not present are ignored;
repeated labels and repeated rows each count; with a single class (or none) in
the training labels the score is its share (0.5 without labels); extra columns,
whatever their names, are ignored (kept by :func:`kept`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import fold_of, table, written

FEATURES = ("log_bytes", "word_length", "upper", "digit", "mark", "rare_mark", "space", "lines", "short_lines", "repeated_lines", "distinct_words", "repeated_words", "stops", "bars", "top_word")
#: Share of the pooled covariance, and of its diagonal, in each class covariance.
POOLED, DIAGONAL = 0.1, 0.05
THRESHOLD = 0.3

_UPPER = V.byte_class(False, on=bytes(range(65, 91)))
_DIGIT = V.byte_class(False, on=b"0123456789")
_MARK = V.byte_class(False, on=b".,;:!?'\"()-")
_RARE = V.byte_class(False, on=b"#$%&*+/<=>@[\\]^_`{|}~")
_STOP = V.byte_class(False, on=b".!?")
_LINE = V.byte_class(True, off=b"\n\r")


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(n / np.maximum(of, 1), 0, 1)))


def _count(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.r_[0, np.cumsum(flag)]
    return c[off[1:]] - c[off[:-1]]


def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and the count of its most frequent one."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    if not len(d):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])])
    size = np.diff(np.r_[new, len(d)])
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[new], size)
    return np.bincount(d[new], minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = [np.zeros((0, len(FEATURES)))]
    for i, j, buf, off in V.slices(texts):
        n, size = j - i, np.diff(off)
        s, e, doc = V.runs(buf, off, V.TOKEN)
        words = np.bincount(doc, minlength=n)
        long = np.bincount(doc, np.minimum(e - s, 40), minlength=n)
        distinct, most = _repeats(V.Hasher(V.LOWER[buf]).spans(s, e), doc, n)
        hasher = V.Hasher(buf)
        ls, le, ldoc = V.runs(buf, off, _LINE)
        lines = np.bincount(ldoc, minlength=n)
        ldistinct, _ = _repeats(hasher.spans(ls, le), ldoc, n)
        out.append(
            np.stack(
                [
                    np.log1p(size),
                    np.log1p(long / np.maximum(words, 1)),
                    _share(_count(_UPPER[buf], off), size),
                    _share(_count(_DIGIT[buf], off), size),
                    _share(_count(_MARK[buf], off), size),
                    _share(_count(_RARE[buf], off), size),
                    _share(size - long, size),
                    np.log1p(lines / np.maximum(words, 1) * 10),
                    _share(np.bincount(ldoc[le - ls < 40], minlength=n), lines),
                    _share(lines - ldistinct, lines),
                    np.log1p(distinct / np.sqrt(np.maximum(words, 1))),
                    _share(words - distinct, words),
                    _share(_count(_STOP[buf], off), words),
                    _share(_count(buf == 124, off), words),
                    _share(most, words),
                ],
                1,
            )
        )
    return np.concatenate(out)


def featurised(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the statistics of each text as the array ``x``."""

    def run(batches):
        for b in batches:
            x = statistics(b.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), flat], names=[*keep, "x"])

    fields = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, fields + "x array<double>")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").values.to_numpy().reshape(-1, len(FEATURES)) if b.num_rows else np.zeros((0, len(FEATURES)))


class Discriminant:
    """Class priors, means and Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, diagonal: float = DIAGONAL):
        k = len(FEATURES)
        self.n = {c: m[0] for c, m in moments.items() if m[0] > 0}
        total = sum(self.n.values())
        self.share = self.n.get(1, 0) / total if total else 0.5
        self.ready = self.n.get(0, 0) > 1 and self.n.get(1, 0) > 1
        if not self.ready:
            return
        mean = {c: m[1] / m[0] for c, m in moments.items()}
        scatter = {c: moments[c][2] - moments[c][0] * np.outer(mean[c], mean[c]) for c in (0, 1)}
        common = (scatter[0] + scatter[1]) / total + 1e-6 * np.eye(k)
        self.parts = {}
        for c in (0, 1):
            cov = scatter[c] / self.n[c]
            cov = (1 - pooled - diagonal) * cov + pooled * common + diagonal * np.diag(np.diag(common))
            chol = np.linalg.cholesky(cov)
            self.parts[c] = np.log(self.n[c] / total) - np.log(np.diag(chol)).sum(), mean[c], np.linalg.inv(chol)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        d = {c: a - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for c, (a, m, w) in self.parts.items()}
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -700, 700)))


def fit(features: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """From all ``labels`` (doc_id and a 0/1 column) of the documents in ``features``."""
    k = len(FEATURES)

    def sums(batches):
        total = {c: np.zeros(1 + k + k * k) for c in (0, 1)}
        for b in batches:
            y, x = b.column("y").to_numpy(zero_copy_only=False), _matrix(b)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([total[0].tolist(), total[1].tolist()], pa.list_(pa.float64()))], names=["c", "m"])

    y = F.col(label).cast("int")
    train = labels.filter(y.isin(0, 1)).select("doc_id", y.alias("y"))
    rows = features.select("doc_id", "x").join(train, "doc_id").select("y", "x").mapInArrow(sums, "c int, m array<double>")
    added = rows.select("c", F.posexplode("m").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + k + k * k))
    for c, i, v in added.collect():  # 2 x (1 + k + k*k) rows
        total[c, i] = v
    return Discriminant({c: (t[0], t[1 : 1 + k], t[1 + k :].reshape(k, k)) for c, t in enumerate(total)})


def scored(features: DataFrame, model: Discriminant, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(shared.value.score(_matrix(b)))], names=[*keep, "score"])

    fields = "".join(f"`{c}` {features.schema[c].dataType.simpleString()}, " for c in keep)
    return features.select(*keep, "x").mapInArrow(run, fields + "score double")


def train_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(fold_of() != 0)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out documents are never read."""
    features = written(featurised(docs))
    out = scored(features, fit(features, train_labels(labels)))
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score below ``threshold``; the model is fitted first, then one scan scores and filters, so no text is shuffled."""
    model = fit(featurised(docs), train_labels(labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.score(statistics(b.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
