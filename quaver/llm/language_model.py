"""LM scoring with a gated recurrent network in numpy.

Corpus counts of every token of all training documents come first (one
shuffle of per-task sums).  They give the base unigram score, the vocabulary
and frequency classes of the network and its output biases.  The network is a
GRU trained by truncated backpropagation with the hidden state carried over
windows; its output softmax factors into class and word within class.  Words
outside its vocabulary share one symbol, which is spelled out by the base
unigram probabilities of those words, so the score is a proper log-likelihood
of the complete document.

Scoring runs many documents side by side in lanes that never pad: a lane takes
the next document when one ends, and the state is carried through the whole of
it.  Counts of up to ``HEAD`` frequent tokens are broadcast (a fixed bound);
occurrences of rarer tokens meet their counts in a shuffle join.

Weights start from a sample of whole training documents of about
``TRAIN_TOKENS`` tokens.  From there every task trains its own copy on all of
its training documents, and the copies are averaged by their tokens: weights,
counts, vocabulary, classes and biases all come from every training document.

Defined cases: a null or empty text is its end token alone; a very long text is
scored whole, with one state carried through it; repeated rows are counted and
scored each; a null id counts as the empty text for the fold; without training
documents every token has the unseen probability; an empty table gives an empty
result; extra columns, whatever their names, are ignored.  Tokens are compared
by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import fold_of, table, written

END = np.uint64(0x5EED0E2D)
#: Most tokens whose counts are broadcast; words of the network; size of a class; width of the network.
HEAD, VOCABULARY, PER_CLASS, WIDTH = 1_000_000, 2048, 32, 16
TRAIN_TOKENS, TRAIN_DOCS, EPOCHS, LANES, STEPS, RATE = 300_000, 2_000, 3, 32, 24, 0.01
#: The pass over all training documents: lanes, learning rate, tokens trained at a time, and parts in which weights are averaged.
PASS_LANES, PASS_RATE, PASS_TOKENS, WEIGHT_PARTS = 256, 0.003, 500_000, 16
HELD_OUT = 1


def tokens(texts: pa.Array):
    """(first row, end row, token hashes with an end after each document, first token of each row)."""
    for i, j, buf, off in V.slices(texts):
        low = V.LOWER[buf]
        s, e, doc = V.runs(low, off, V.TOKEN)
        h = V.Hasher(low).spans(s, e) if len(s) else np.zeros(0, np.uint64)
        first = V.per_doc(doc, j - i)
        yield i, j, np.insert(h, first[1:], END), first + np.arange(j - i + 1)


def counted(docs: DataFrame) -> DataFrame:
    """(h, c): hash and count of every token."""

    def merge(parts):
        h, c = (np.concatenate(x) for x in zip(*parts))
        u, back = np.unique(h, return_inverse=True)
        return u, np.bincount(back, c, minlength=len(u)).astype(np.int64)

    def run(batches):
        held = []
        for b in batches:
            for _, _, h, _ in tokens(b.column("text")):
                held.append(np.unique(h, return_counts=True))
                if sum(len(x[0]) for x in held) > 3_000_000:
                    held = [merge(held)]
                    if len(held[0][0]) > 1_500_000:
                        yield batch(*held.pop())
        if held:
            yield batch(*merge(held))

    def batch(h, c):
        return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Head counts and the network's words: symbol 0 is 'other', then words by falling count."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int, distinct: int, words: int = VOCABULARY):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.total, self.distinct = total, distinct
        self.floor = math.log10(total + 0.5 * (distinct + 1)) if total + distinct else math.log10(0.5)
        by_count = np.lexsort((self.h, -self.c))[: words - 1]
        by_count = by_count[self.c[by_count] > 1] if len(by_count) else by_count
        self.symbol = np.zeros(len(self.h), np.int32)
        self.symbol[by_count] = 1 + np.arange(len(by_count))
        p = (self.c[by_count] + 0.5) / 10**self.floor
        self.other = max(1e-12, 1 - float(p.sum()))
        self.p = np.r_[self.other, p]
        self.at_end = int(self.symbol[k]) if len(self.h) and (k := int(np.searchsorted(self.h, END))) < len(self.h) and self.h[k] == END else 0

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, count, in the head) of each token."""
        u, back = np.unique(h, return_inverse=True)
        if not len(self.h):
            z = np.zeros(len(h), np.int64)
            return z.astype(np.int32), z, np.zeros(len(h), bool)
        k = np.minimum(np.searchsorted(self.h, u), len(self.h) - 1)
        ok = self.h[k] == u
        return np.where(ok, self.symbol[k], 0)[back].astype(np.int32), np.where(ok, self.c[k], 0)[back], ok[back]


def _log_share(a: np.ndarray, k: np.ndarray, bounded: bool) -> np.ndarray:
    """Log of the share that place k of each row has in the row's exponentials; ``a`` is used up."""
    if not bounded:
        a -= a.max(1, keepdims=True)
    out = a[np.arange(len(k)), k]
    np.exp(a, out=a)
    total = a @ np.ones(a.shape[1], a.dtype)
    out -= np.log(total, out=total)
    return out


def _errors(a: np.ndarray, k: np.ndarray, bounded: bool) -> np.ndarray:
    """Softmax of each row minus one at place k; ``a`` is used up."""
    if not bounded:
        a -= a.max(1, keepdims=True)
    np.exp(a, out=a)
    a *= (1 / (a @ np.ones(a.shape[1], a.dtype)))[:, None]
    a[np.arange(len(k)), k] -= 1
    return a


class Network:
    """GRU with a class-factored softmax; classes are runs of PER_CLASS words of like frequency."""

    def __init__(self, p: np.ndarray, width: int = WIDTH, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        n, self.per = len(p), PER_CLASS
        self.classes = -(-n // self.per)
        full = np.zeros(self.classes * self.per)
        full[:n] = p
        full = full.reshape(self.classes, self.per)
        with np.errstate(divide="ignore"):
            within = np.log(np.maximum(full / full.sum(1, keepdims=True), 1e-30))
        f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.w = {
            "emb": f(n, width), "wx": f(width, 3 * width) * 3, "b": np.zeros(3 * width, np.float32), "u": f(width, 3 * width) * 3,
            "wc": f(width, self.classes) * 0.1, "bc": np.log(full.sum(1)).astype(np.float32), "ww": f(self.classes, width, self.per) * 0.1, "bw": within.astype(np.float32),
        }
        self.w["b"][:width] = 1.0  # remember at first
        self.width = width

    def step(self, gx: np.ndarray, h: np.ndarray):
        k = self.width
        gh = h @ self.w["u"]
        zr = gx[:, : 2 * k] + gh[:, : 2 * k]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :k], zr[:, k:]
        n = r * gh[:, 2 * k :]
        n += gx[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, gh[:, 2 * k :]

    def bounded(self) -> bool:
        """No state can make an exponential of a class or word overflow, so that none has to be scaled by the largest one."""
        top = lambda w, b: float((np.abs(w).sum(-2) + b).max())
        return max(top(self.w["wc"], self.w["bc"]), top(self.w["ww"], self.w["bw"])) < 60

    def _by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Classes, the order that sorts by them, and where each class starts in that order."""
        cls = (y // self.per).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        return cls, order, np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()

    def log_p(self, h: np.ndarray, y: np.ndarray, bounded: bool = False) -> np.ndarray:
        """Natural log probability of each symbol after its state."""
        cls, order, bound = self._by_class(y)
        h, cls, word = h[order], cls[order], (y % self.per)[order]
        own = np.empty(len(y), np.float32)
        a = h @ self.w["wc"]
        a += self.w["bc"]
        out = _log_share(a, cls, bounded)
        for c in range(self.classes):
            i, j = bound[c], bound[c + 1]
            if i < j:
                a = h[i:j] @ self.w["ww"][c]
                a += self.w["bw"][c]
                out[i:j] += _log_share(a, word[i:j], bounded)
        own[order] = out
        return own

    def train(self, lanes: np.ndarray, fresh: np.ndarray, start: int, epochs: int = EPOCHS, steps: int = STEPS, rate: float = RATE, adam: dict | None = None) -> None:
        """lanes: symbols (lane, time); fresh: where a document begins; truncated backpropagation, Adam, whose state may be carried on."""
        adam = {} if adam is None else adam
        m = adam.setdefault("m", {k: np.zeros_like(v) for k, v in self.w.items()})
        s = adam.setdefault("s", {k: np.zeros_like(v) for k, v in self.w.items()})
        k, t = self.width, adam.get("t", 0)
        before = np.concatenate([np.full((len(lanes), 1), start, lanes.dtype), lanes[:, :-1]], 1)
        before[fresh] = start
        for _ in range(epochs):
            h = np.zeros((len(lanes), k), np.float32)
            for a in range(0, lanes.shape[1], steps):
                x, y, new = before[:, a : a + steps].T.ravel(), lanes[:, a : a + steps].T.ravel(), fresh[:, a : a + steps].T
                w, kept, b, resets = self.w, [], len(lanes), new.any(1).tolist()
                gates = (w["emb"] @ w["wx"] + w["b"])[x]
                for i, reset in enumerate(resets):
                    if reset:
                        h[new[i]] = 0
                    nxt, z, r, n, hn = self.step(gates[i * b : (i + 1) * b], h)
                    kept.append((h, z, r, n, hn, nxt))
                    h = nxt.copy() if i + 1 < len(resets) and resets[i + 1] or i + 1 == len(resets) else nxt
                h0, z, r, n, hn, states = (np.concatenate(c) for c in zip(*kept))
                g = {key: np.zeros_like(v) for key, v in w.items()}
                dflat = self._output_gradient(states, y, g)
                # a gate's error is the state's error times what is known before going back in time
                to_n = (1 - z) * (1 - n * n)
                factor = np.stack([(h0 - n) * z * (1 - z), to_n * hn * r * (1 - r), to_n * r], 1)
                dgh, back = np.empty_like(factor), np.ascontiguousarray(w["u"].T)
                dh = np.zeros_like(h)
                for i in reversed(range(len(resets))):
                    own = slice(i * b, (i + 1) * b)
                    d = dflat[own]
                    d += dh
                    np.multiply(d[:, None], factor[own], out=dgh[own])
                    dh = d * z[own]
                    dh += dgh[own].reshape(b, 3 * k) @ back
                    if resets[i]:
                        dh[new[i]] = 0
                dgx, dgh = dgh.copy(), dgh.reshape(-1, 3 * k)
                np.multiply(dflat, to_n, out=dgx[:, 2])
                g["u"] += h0.T @ dgh
                dgx = dgx.reshape(-1, 3 * k)
                g["wx"] += w["emb"][x].T @ dgx
                g["b"] += np.ones(len(x), np.float32) @ dgx
                order = np.argsort(x.astype(np.min_scalar_type(len(w["emb"]))), kind="stable")
                begin = np.flatnonzero(np.diff(x[order], prepend=-1))
                g["emb"][x[order[begin]]] += np.add.reduceat((dgx @ w["wx"].T)[order], begin, axis=0)
                t += 1
                fade = rate / (1 + 0.002 * t)
                for key in w:
                    q = g[key]
                    q *= 1 / len(y)
                    np.clip(q, -1, 1, out=q)
                    m[key] *= 0.9
                    m[key] += 0.1 * q
                    s[key] *= 0.99
                    q *= q
                    q *= 0.01
                    s[key] += q
                    np.multiply(s[key], 1 / (1 - 0.99**t), out=q)
                    np.sqrt(q, out=q)
                    q += 1e-6
                    np.divide(m[key], q, out=q)
                    q *= fade / (1 - 0.9**t)
                    w[key] -= q
        adam["t"] = t

    def _output_gradient(self, h: np.ndarray, y: np.ndarray, g: dict) -> np.ndarray:
        w = self.w
        cls, order, bound = self._by_class(y)
        h, cls, word = h[order], cls[order], (y % self.per)[order]
        bounded = self.bounded()
        a = h @ w["wc"]
        a += w["bc"]
        p = _errors(a, cls, bounded)
        g["wc"] += h.T @ p
        ones = np.ones(len(y), np.float32)
        g["bc"] += ones @ p
        d = p @ w["wc"].T
        for c in range(self.classes):
            i, j = bound[c], bound[c + 1]
            if i < j:
                own = h[i:j]
                a = own @ w["ww"][c]
                a += w["bw"][c]
                p = _errors(a, word[i:j], bounded)
                g["ww"][c] += own.T @ p
                g["bw"][c] += ones[i:j] @ p
                d[i:j] += p @ w["ww"][c].T
        out = np.empty_like(d)
        out[order] = d
        return out

    def score(self, symbols: np.ndarray, first: np.ndarray, start: int, lanes: int = 512, steps: int = 32) -> np.ndarray:
        """Natural log-likelihood of each document; document d has symbols[first[d]:first[d + 1]], at least one."""
        n = len(first) - 1
        length = np.diff(first)
        out = np.zeros(n)
        lanes = max(1, min(lanes, n))
        heap, member = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for d in np.argsort(-length, kind="stable").tolist():
            load, k = heapq.heappop(heap)
            member[k].append(d)
            heapq.heappush(heap, (load + int(length[d]), k))
        member = sorted((x for x in member if x), key=lambda x: -sum(length[d] for d in x))
        # one stream of tokens, lane after lane, with the previous symbol (or the start) beside each
        docs = np.array([d for x in member for d in x])
        size = length[docs]
        where = np.repeat(first[:-1][docs] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        y = symbols[where]
        x = np.r_[start, y[:-1]].astype(np.int32)
        begin = np.r_[0, np.cumsum(size)[:-1]]
        x[begin] = start
        fresh = np.zeros(len(y), bool)
        fresh[begin] = True
        owner = np.repeat(docs, size)
        load = np.array([sum(int(length[d]) for d in m) for m in member])
        at = np.r_[0, np.cumsum(load)[:-1]]
        table_ = self.w["emb"] @ self.w["wx"] + self.w["b"]
        h, bounded = np.zeros((len(load), self.width), np.float32), self.bounded()
        states, places, waiting = [], [], 0
        for t in range(int(load[0])):
            live = int(np.searchsorted(-load, -t, "left"))  # lanes are sorted by falling load
            k = at[:live] + t
            new = fresh[k]
            own = h[:live]
            if new.any():
                own[new] = 0
            own = self.step(table_[x[k]], own)[0]
            h[:live] = own
            states.append(own)
            places.append(k)
            waiting += live
            if waiting >= 65_536 or t + 1 == load[0]:
                k = np.concatenate(places)
                out += np.bincount(owner[k], self.log_p(np.concatenate(states), y[k], bounded), minlength=n)
                states, places, waiting = [], [], 0
        return out


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """From stored counts; the head is every token of at least the least count that keeps it within ``head``."""
    sizes = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("c").desc())
    least, got, total, distinct = None, 0, 0, 0
    open_ = True
    for c, n in sizes.toLocalIterator():
        total += c * n
        distinct += n
        open_ = open_ and got + n <= head
        if open_:
            got, least = got + n, c
    if least is None:
        return Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), total, distinct)
    t = counts.filter(F.col("c") >= least).toArrow()  # at most `head` rows
    return Vocabulary(t.column("h").to_numpy().astype(np.uint64), t.column("c").to_numpy(), total, distinct)


def trained(docs: DataFrame, words: Vocabulary, sample_tokens: int = TRAIN_TOKENS, sample_docs: int = TRAIN_DOCS) -> Network:
    """A network for ``words``; ``docs`` are the training documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")

    def run(batches):
        words = shared.value
        net = Network(words.p)
        parts, starts, n = [], [], 0
        for b in batches:
            for i, j, h, first in tokens(b.column("text")):
                symbol = words.look_up(h)[0]
                for d in range(j - i):
                    if n < sample_tokens:
                        parts.append(symbol[first[d] : first[d + 1]])
                        starts.append(n)
                        n += len(parts[-1])
        if n:
            lanes = min(LANES, n)
            width = n // lanes
            stream, fresh = np.concatenate(parts), np.zeros(n, bool)
            fresh[starts] = True
            lanes_ = stream[: lanes * width].reshape(lanes, width)
            net.train(lanes_, fresh[: lanes * width].reshape(lanes, width) | (np.arange(width) == 0), words.at_end)
        names = list(net.w)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([net.w[k].astype("<f4").tobytes() for k in names], pa.binary())], names=["name", "w"])

    net = Network(words.p)
    for name, raw in sample.mapInArrow(run, "name string, w binary").collect():  # the network's weights, a fixed size
        net.w[name] = np.frombuffer(raw, "<f4").reshape(net.w[name].shape).copy()
    return net


def averaged(docs: DataFrame, words: Vocabulary, net: Network) -> tuple[Network, int]:
    """``net`` after a pass over all of ``docs``, each task on its own rows; and the tokens trained on."""
    spark = docs.sparkSession
    # only the network's own words are needed here, not the counts of the head
    own = np.flatnonzero(words.symbol)
    shared = spark.sparkContext.broadcast((words.h[own], words.symbol[own], words.p, words.at_end, net.w))

    def run(batches):
        known, symbol, p, at_end, start = shared.value
        net = Network(p)
        net.w = {k: v.copy() for k, v in start.items()}
        adam: dict = {}
        held, fresh, n, seen = [], [], 0, 0

        def learn(last: bool) -> None:
            nonlocal held, fresh, n, seen
            stream, begin = np.concatenate(held), np.concatenate(fresh)
            lanes = min(PASS_LANES, n)
            while len(stream) and (last or len(stream) >= PASS_LANES * STEPS):
                width = len(stream) // lanes
                own = lanes * width
                net.train(stream[:own].reshape(lanes, width), begin[:own].reshape(lanes, width) | (np.arange(width) == 0), at_end, 1, rate=PASS_RATE, adam=adam)
                seen += own
                stream, begin = stream[own:], begin[own:]
                lanes = max(1, min(lanes, len(stream)))
                if not last:
                    break
            held, fresh, n = [stream], [begin], len(stream)

        for b in batches:
            for _, _, h, first in tokens(b.column("text")):
                begin = np.zeros(len(h), bool)
                begin[first[:-1]] = True
                k = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                held.append(np.where(known[k] == h, symbol[k], 0).astype(np.int32) if len(known) else np.zeros(len(h), np.int32))
                fresh.append(begin)
                n += len(h)
                if n >= PASS_TOKENS:
                    learn(False)
        if n:
            learn(True)
        if seen:
            cut = [(name, part, x.astype("<f8") * seen) for name, w in net.w.items() for part, x in enumerate(np.array_split(w.ravel(), WEIGHT_PARTS))]
            yield batch([x[0] for x in cut], [x[1] for x in cut], [seen] * len(cut), [x[2] for x in cut])

    def batch(names, at, weights, values):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at, pa.int32()), pa.array(weights, pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())], names=["name", "part", "tokens", "w"])

    def add(batches):
        total: dict = {}
        for b in batches:
            for name, part, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                m, w = total.get((name, part), (0, 0.0))
                total[name, part] = m + n, w + np.frombuffer(raw, "<f8")
        if total:
            yield batch([k[0] for k in total], [k[1] for k in total], [x[0] for x in total.values()], [x[1] for x in total.values()])

    schema = "name string, part int, tokens long, w binary"
    rows = docs.select("text").mapInArrow(run, schema).repartition(WEIGHT_PARTS, "name", "part").mapInArrow(add, schema).collect()  # the network's weights, a fixed size
    out, seen = Network(words.p), max((r.tokens for r in rows), default=0)
    out.w = {k: v.copy() for k, v in net.w.items()}
    for name in {r.name for r in rows}:
        own = sorted((r for r in rows if r.name == name), key=lambda r: r.part)
        out.w[name] = np.concatenate([np.frombuffer(r.w, "<f8") / r.tokens for r in own]).astype(np.float32).reshape(net.w[name].shape)
    return out, seen


def scored(docs: DataFrame, counts: DataFrame, words: Vocabulary, net: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, n_known, base_score and score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast((words, net))
    log_other = math.log10(words.other)
    unseen = math.log10(0.5) - words.floor
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        from pyspark import TaskContext

        words, net = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            cols = [[] for _ in range(5)]
            rare = []
            symbols, firsts, base_at = [], [], 0
            for i, j, h, first in tokens(b.column("text")):
                symbol, c, ok = words.look_up(h)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                lp = np.where(ok, np.log10(c + 0.5) - words.floor, unseen)
                cols[0].append(np.diff(first))
                cols[1].append(np.bincount(doc, ok, minlength=j - i).astype(np.int64))
                cols[2].append(np.bincount(doc, lp, minlength=j - i))
                out = symbol == 0
                cols[3].append(np.bincount(doc[out], lp[out] - log_other, minlength=j - i).astype(float))  # numpy counts nothing in integers
                left = np.flatnonzero(~ok)
                bound = np.searchsorted(doc[left], np.arange(j - i + 1))
                rare.append(pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(h[left].astype(np.int64))))
                symbols.append(symbol)
                firsts.append(first[:-1] + base_at)
                base_at += len(symbol)
            if not firsts:
                continue
            first = np.r_[np.concatenate(firsts), base_at]
            neural = net.score(np.concatenate(symbols), first, words.at_end) / math.log(10)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keep), pa.array(row + np.arange(n)), *(pa.array(np.concatenate(x)) for x in cols[:4]), pa.array(neural), pa.concat_arrays(rare)],
                names=[*keep, "_row", "n_tokens", "n_known", "base", "spelled", "neural", "rare"],
            )
            row += n

    first = written(docs.select(*keep, "text").mapInArrow(run, fields + "_row long, n_tokens long, n_known long, base double, spelled double, neural double, rare array<long>"))
    # rarer tokens meet their counts; those without a count keep the unseen probability they already have
    met = first.select("_row", F.explode("rare").alias("h")).join(counts, "h")
    extra = met.groupBy("_row").agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("c") + 0.5) - F.lit(math.log10(0.5))).alias("gain"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        first.drop("rare")
        .join(extra, "_row", "left")
        .select(*keep, "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), (F.col("base") + zero("gain")).alias("base_score"), (F.col("neural") + F.col("spelled") + zero("gain")).alias("score"))
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    train = docs.filter(fold_of() != HELD_OUT)
    counts = written(counted(train))
    words = vocabulary(counts)
    out = scored(docs, counts, words, averaged(train, words, trained(train, words))[0])
    return out.select("doc_id", (fold_of() == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
