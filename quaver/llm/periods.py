"""Periodic runs of words, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q (words q apart are equal)
that no neighbouring word extends, of at least ``LEAST`` words and ``TIMES``
periods.  Such a stretch shows as an island of equal words at lag q:

1. Matches are counted for every lag up to a third of the text.  Occurrences of
   a rare word give their pair differences.  A word that occurs more often than
   sqrt(n log n) times is frequent: the autocorrelation of its places comes from
   an FFT, rounded to whole numbers (it errs by far less than a half).
2. Lags are taken upwards.  Only a lag with as many matches as its shortest run
   needs is scanned for islands.  A run of period p explains matches at the
   multiples of p, and none of them can belong to a run of such a lag (its
   stretch would share fewer words with the run than the lag has), so they are
   taken off first: one word repeated a million times costs one scan.
3. A stretch of at least three periods q has a smallest period that divides q;
   an island counts only if none of q's proper divisors is a period.

Each text is worked on by itself, so no rows meet and nothing is shuffled.

Defined cases: null and empty texts have no words, no runs and an empty collapsed
text; fewer than ``LEAST`` words have no runs; a very long text takes time
n sqrt(n log n) at most for its counts, and memory in proportion to n; repeated
rows give equal rows; runs of the same strength rank by start, then period; an
empty table gives an empty result; extra columns, whatever their names, are
ignored.  A null doc_id counts as the empty text where ids are hashed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

LEAST, TIMES = 24, 3
#: Words of texts that are counted together.
TOGETHER = 50_000
#: Values in one group of transforms.
_SPECTRUM = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN = "struct<start: long, length: long, period: long>"


def numbered(words: list[bytes], first: int = 0) -> np.ndarray:
    """Equal numbers for equal words, counted from ``first``."""
    seen: dict[bytes, int] = {}
    return np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words)) + first


def _transform_size(n: int) -> int:
    """The least of 2^k, 3 2^k and 5 2^k that is not below n."""
    return min(m << max(0, math.ceil(math.log2(n / m))) for m in (1, 3, 5))


def _correlated(places: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """Matches at lags 0..most of words at these places of a text of n words: the transform is long enough that none wraps round."""
    size = _transform_size(n + most + 1)
    power = np.zeros(size // 2 + 1)
    step = max(1, _SPECTRUM // size)
    for k in range(0, len(places), step):
        x = np.zeros((min(step, len(places) - k), size))
        for row, own in zip(x, places[k : k + step]):
            row[own] = 1
        f = np.fft.rfft(x)
        power += (f.real**2 + f.imag**2).sum(0)
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_matches(word: np.ndarray, off: np.ndarray, heavy: int | None = None) -> np.ndarray:
    """Equal words at each lag of each text, at off[text] + lag, for lags up to a third of the text; word numbers differ between texts.

    ``heavy`` is the frequency above which a word is transformed; by default it follows the length of the text.
    """
    n = np.diff(off)
    most = n // TIMES
    out = np.zeros(len(word) + 1, np.int64)
    if not len(word):
        return out
    doc = np.repeat(np.arange(len(n)), n)
    bound = np.full(len(n), heavy) if heavy is not None else np.maximum(32, np.sqrt(n * np.log2(np.maximum(n, 2)))).astype(np.int64)
    count = np.bincount(word)
    place = np.argsort(word, kind="stable")
    end = np.repeat(np.cumsum(count), count)
    frequent = count[word[place]] > bound[doc[place]]
    # light: the k-th next occurrence of each place, for k = 1, 2, ... while any is near enough
    at, k, found, held = np.flatnonzero(~frequent), 1, [], 0
    while len(at):
        at = at[at + k < end[at]]
        lag = place[at + k] - place[at]
        own = doc[place[at]]
        near = lag <= most[own]
        at = at[near]
        found.append(off[own[near]] + lag[near])
        held += len(at)
        if held > len(word) or not len(at):
            out += np.bincount(np.concatenate(found), minlength=len(out))
            found, held = [], 0
        k += 1
    # heavy: each text's frequent words through one inverse transform
    first = np.flatnonzero(frequent & (np.r_[0, end[:-1]] == np.arange(len(end))))
    for d in np.unique(doc[place[first]]).tolist():
        own = first[doc[place[first]] == d]
        out[off[d] : off[d] + most[d] + 1] += _correlated([place[a : end[a]] - off[d] for a in own.tolist()], int(n[d]), int(most[d]))
    return out


def _primitive(block: np.ndarray, q: int) -> bool:
    """No proper divisor of q is a period of a stretch that starts with ``block``, its first 2q words."""
    rest, r = q, 2
    while rest > 1:
        if rest % r:
            r = r + 1 if r * r <= rest else rest
            continue
        d = q // r
        if (block[:q] == block[d : d + q]).all():
            return False
        while rest % r == 0:
            rest //= r
    return True


def islands(w: np.ndarray, matches: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, given its matches by lag (from lag 0), by start, then period."""
    lag = np.arange(len(matches))
    need = np.maximum(LEAST - lag, (TIMES - 1) * lag)
    left, runs = matches.copy(), []
    for q in np.flatnonzero((matches >= need) & (lag > 0)).tolist():
        if left[q] < need[q]:
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, w[q:] == w[:-q], False]))
        start, count = edge[::2], edge[1::2] - edge[::2]
        for s, c in zip(start[count >= need[q]].tolist(), count[count >= need[q]].tolist()):
            if _primitive(w[s : s + 2 * q], q):
                runs.append((s, c + q, q))
                multiples = np.arange(2 * q, min(c + q, len(left)), q)
                left[multiples] -= c + q - multiples
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; ties to the smallest start, then period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run contains after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for s, length, q in runs:
            keep[s + q : s + length] = False
        words = [words[k] for k in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    long = [k for k, words in enumerate(texts) if len(words) >= LEAST]
    if not long:
        return out
    off, ids, first = np.r_[0, np.cumsum([len(texts[k]) for k in long])], [], 0
    for k in long:
        ids.append(numbered(texts[k], first))
        first = int(ids[-1].max()) + 1
    matches = lag_matches(np.concatenate(ids), off)
    for k, w, o in zip(long, ids, off.tolist()):
        out[k] = islands(w, matches[o : o + len(w) // TIMES + 1])
    return out


def _slices(texts: list[list[bytes]]):
    start, held = 0, 0
    for k, words in enumerate(texts):
        held += len(words)
        if held >= TOGETHER:
            yield texts[start : k + 1]
            start, held = k + 1, 0
    yield texts[start:]


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_words, runs (by start, then period), strongest (null without runs) and collapsed (the text with each run cut to one period)."""

    def run(batches):
        for b in batches:
            texts = [(t or "").encode().split() for t in b.column("text").to_pylist()]  # bytes split at \x20 and \x09-\x0D
            runs = [r for part in _slices(texts) for r in runs_of(part)]
            named = lambda r: r and dict(zip(("start", "length", "period"), r))
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in keep),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[named(x) for x in r] for r in runs], pa.list_(_RUN)),
                    pa.array([named(strongest(r)) for r in runs], _RUN),
                    pa.array([collapsed(t, r).decode() for t, r in zip(texts, runs)], pa.string()),
                ],
                names=[*keep, "n_words", "runs", "strongest", "collapsed"],
            )

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")


def cycled(doc_id: Column, text: Column) -> Column:
    """The contract's edit: every tenth text, by the hash of its id, repeats a stretch of its words to the end."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def edited(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # a lambda's variable is bound once for each row, where a column would be split again for each word
    whole = F.array_join(F.transform(F.array(words), edited)[0], " ")
    return F.when((h % 10 == 0) & text.isNotNull(), whole).otherwise(text)


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", cycled(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.col("strongest")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return periodic_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
