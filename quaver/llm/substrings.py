"""Suffix-array dedup: removes repeated passages of at least ``LENGTH`` bytes.

1. Every window of LENGTH bytes has an anchor: the position of its smallest
   ``GRAM``-byte hash (rightmost on ties).  Equal windows have equal anchors at
   equal offsets, so a window can only repeat where its anchor's gram does.
   Texts that occur more than once are resolved as a whole and stand for one.
2. Grams that occur once are dropped by a shuffle count.  Each remaining anchor
   gives one suffix (from the anchor to the end of its last window) with the
   left context that its windows need.
3. Tasks sort their suffixes into runs, merge equal ones, and exchange the runs
   front-coded.  Runs are combined with a loser tree whose entries keep the
   prefix length they share with the last winner, so known prefixes are never
   compared again; it yields the suffix array with its common-prefix lengths.
4. A window reaching r bytes right of its anchor can only repeat if a neighbour
   in the array shares r bytes; those windows are matched within the array.

On request it also marks the texts of which ``words`` consecutive words stand in
another document, however few bytes they have; nothing is removed for that.
Windows of words have their smallest hash of ``WORD_GRAM`` words as anchor, which
passes the same count; those at repeated anchors are matched in the merging tasks.

Defined cases: a null or empty text has nothing to remove; texts shorter than
LENGTH are left whole; repeated rows are documents like any other, so each of
them loses whatever repeats; a null id is kept; bytes may be cut inside a code
point, as texts are bytes here; a very long text is read whole, as a slice
of its own; an empty table gives an empty result; ids are whole numbers; extra
columns, whatever their names, are ignored.  Equal texts, grams and windows are
found by 64-bit hashes, windows of words at one anchor by 40 bits.  Words are cut
at ASCII white space and compared as they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import parts, table, written
from .decontaminate import merged

LENGTH, GRAM = 400, 256
#: A passage of over 50 words, and the words of its anchor.
WORDS, WORD_GRAM = 51, 20
#: Suffixes that one merging task gets, as a mean.
ROUTE_SUFFIXES = 50_000
_LOW = np.uint64((1 << 24) - 1)
_FORTY = np.uint64((1 << 40) - 1)
_CHUNK = 1 << 23
_NONE = -(1 << 63)


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first window, last window) of one slice; windows never cross documents."""
    out = [np.zeros((4, 0), np.int64)]
    span = length - gram + 1
    for c in range(0, max(len(buf) - length + 1, 0), _CHUNK):
        part = buf[c : c + _CHUNK + length - 1]
        h = V.Hasher(part).grams(gram)
        packed = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        least = V.window_min(packed, span)
        ok = np.flatnonzero(V.cuts(len(buf), off, length)[c : c + len(least)])
        p = (_LOW - (least[ok] & _LOW)).astype(np.int64)
        if not len(p):
            continue
        # windows of one document follow each other; a new anchor or a gap starts a new run
        new = np.r_[True, (p[1:] != p[:-1]) | (ok[1:] != ok[:-1] + 1)]
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(p) - 1]
        out.append(np.stack([h[p[new]].astype(np.int64), p[new] + c, ok[new] + c, ok[last] + c]))
    return tuple(np.concatenate(out, 1))


def word_windows(buf: np.ndarray, off: np.ndarray, words: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, hash) of each window of ``words`` words of one slice, and where those of each document begin."""
    none = np.zeros(0, np.uint64)
    least, windows, doc = none, none, np.zeros(0, np.int64)
    if words:
        start, end, of = V.runs(buf, off, V.TOKEN)
        if len(start) >= words:
            h, gram = V.Hasher(buf).spans(start, end), min(WORD_GRAM, words)
            ok = np.flatnonzero(V.cuts(len(h), V.per_doc(of, len(off) - 1), words)[: len(h) - words + 1])
            least, windows, doc = V.window_min(V.combine(h, gram), words - gram + 1)[ok], V.combine(h, words)[ok], of[ok]
    return least.view(np.int64), windows, V.per_doc(doc, len(off) - 1)


def _grams(length: int, gram: int, words: int | None):
    def run(batches):
        for b in batches:
            lists, long = [], []
            for _, _, buf, off in V.slices(b.column("text")):
                h, p, _, _ = anchors(buf, off, length, gram)
                bound = np.searchsorted(p, off)
                least, _, first = word_windows(buf, off, words)
                long += (np.diff(first) > 0).tolist()
                for d in range(len(off) - 1):
                    # a gram that repeats within a text is listed twice, however often it does
                    one, count = np.unique(h[bound[d] : bound[d + 1]], return_counts=True)
                    lists.append(np.r_[one, one[count > 1], np.unique(least[first[d] : first[d + 1]])])
            if lists:
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("th"), b.column("n"), pa.array(long, pa.bool_()), pa.array(lists, pa.list_(pa.int64()))], names=["key", "th", "n", "long", "hs"])

    return run


def lcp(a: bytes, b: bytes, at: int = 0) -> int:
    """Common prefix of two byte strings that already share ``at`` bytes."""
    end, step = min(len(a), len(b)), 16
    while at < end and a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    if at >= end:
        return end
    hi = min(end, at + step)
    while at < hi:
        mid = (at + hi + 1) // 2
        if a[at:mid] == b[at:mid]:
            at = mid
        else:
            hi = mid - 1
    return at


class LoserTree:
    """Merges sorted runs of (suffix, item) with their in-run prefix lengths."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs, self.place = runs, [0] * len(runs)
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.shared = [0] * self.size  # with the last winner
        self.loser = [-1] * self.size
        self.winner = self._build(1)

    def _head(self, r: int) -> bytes | None:
        if r < len(self.runs) and self.place[r] < len(self.runs[r][0]):
            return self.runs[r][0][self.place[r]]
        return None

    def _play(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes the one with the winner."""
        a, b = self._head(x), self._head(y)
        if b is None:
            return x, y
        if a is None:
            return y, x
        if self.shared[x] != self.shared[y]:
            return (x, y) if self.shared[x] > self.shared[y] else (y, x)
        n = lcp(a, b, self.shared[x])
        if n == len(a) and (n < len(b) or x < y) or n < len(a) and n < len(b) and a[n] < b[n]:
            self.shared[y] = n
            return x, y
        self.shared[x] = n
        return y, x

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        w, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return w

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, place, bytes shared with the suffix before) in sorted order."""
        while self._head(self.winner) is not None:
            w = self.winner
            yield w, self.place[w], self.shared[w]
            self.place[w] += 1
            if self.place[w] < len(self.runs[w][0]):
                self.shared[w] = self.runs[w][1][self.place[w]]
            node = (w + self.size) // 2
            while node:
                w, self.loser[node] = self._play(w, self.loser[node])
                node //= 2
            self.winner = w


_ITEM = [("lcp", "<u2"), ("rest", "<u2"), ("left", "<u2"), ("weight", "<u1"), ("key", "<i8"), ("th", "<i8"), ("n", "<i8"), ("a", "<i8")]
_DONE = [("key", "<i8"), ("th", "<i8"), ("n", "<i8"), ("s", "<i8"), ("e", "<i8")]


def encode_run(items: list[tuple], done: list[tuple]) -> bytes:
    """items: sorted (suffix, left, weight, key, th, n, a); done: resolved intervals. Front-coded."""
    table_, body, before = np.zeros(len(items), _ITEM), [], b""
    for k, (suffix, left, weight, key, th, n, a) in enumerate(items):
        same = lcp(before, suffix)
        table_[k] = same, len(suffix) - same, len(left), weight, key, th, n, a
        body += [suffix[same:], left]
        before = suffix
    head = np.array([len(items), len(done)], "<i8").tobytes()
    return b"".join([head, table_.tobytes(), np.array(done, _DONE).tobytes(), *body])


def decode_run(raw: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    n, m = np.frombuffer(raw, "<i8", 2)
    items = np.frombuffer(raw, _ITEM, n, 16)
    at = 16 + n * items.dtype.itemsize
    done = np.frombuffer(raw, _DONE, m, at)
    at += m * done.dtype.itemsize
    suffixes, lefts, before = [], [], b""
    for same, rest, left in zip(items["lcp"].tolist(), items["rest"].tolist(), items["left"].tolist()):
        before = before[:same] + raw[at : at + rest]
        suffixes.append(before)
        lefts.append(raw[at + rest : at + rest + left])
        at += rest + left
    return items, done, suffixes, lefts


def joined(done: list[tuple]) -> list[tuple]:
    """Resolved intervals with the overlapping ones of a text made one."""
    out: list[tuple] = []
    for x in sorted(done):
        if out and out[-1][:3] == x[:3] and x[3] <= out[-1][4]:
            out[-1] = (*out[-1][:4], max(out[-1][4], x[4]))
        else:
            out.append(x)
    return out


_TEXT = [("key", "<i8"), ("th", "<i8"), ("n", "<i8"), ("shared", "?")]
_ANCHOR = [("h", "<i8"), ("text", "<u4"), ("windows", "<u4")]


class WordRun:
    """Windows of words at repeated anchors, of the texts that one task sends to one route."""

    def __init__(self):
        self.texts: list[list] = []
        self.anchors: list[tuple] = []
        self.body: list[bytes] = []
        self.seen: dict[tuple[int, bytes], int] = {}

    def add(self, text: tuple, h: np.ndarray, windows: np.ndarray) -> None:
        t = len(self.texts)
        self.texts.append([*text, False])
        ends = np.r_[np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h)].tolist()
        low = np.ascontiguousarray(windows.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        for a, z in zip(ends, ends[1:]):
            key = int(h[a]), low[a:z].tobytes()
            before = self.seen.setdefault(key, t)
            if before == t:
                self.anchors.append((key[0], t, z - a))
                self.body.append(key[1])
            else:  # equal contexts share all their windows; the first stands for both
                self.texts[before][3] = self.texts[t][3] = True

    def encoded(self) -> bytes:
        head = np.array([len(self.texts), len(self.anchors)], "<i8").tobytes()
        return b"".join([head, np.array([tuple(x) for x in self.texts], _TEXT).tobytes(), np.array(self.anchors, _ANCHOR).tobytes(), *self.body])


def sharing(raws: list[bytes]) -> np.ndarray:
    """The texts of these word runs that share a window with another text."""
    texts, who, keys, at = [np.zeros(0, _TEXT)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for raw in raws:
        n, m = np.frombuffer(raw, "<i8", 2).tolist()
        own = np.frombuffer(raw, _TEXT, n, 16)
        anchor = np.frombuffer(raw, _ANCHOR, m, 16 + own.nbytes)
        low = np.zeros((int(anchor["windows"].sum()), 8), np.uint8)
        low[:, :5] = np.frombuffer(raw, np.uint8, 5 * len(low), 16 + own.nbytes + anchor.nbytes).reshape(-1, 5)
        texts.append(own)
        who.append(np.repeat(anchor["text"].astype(np.int64) + at, anchor["windows"]))
        keys.append(V.mix(low.view("<u8").ravel() ^ V.mix(np.repeat(anchor["h"], anchor["windows"]).view(np.uint64))))
        at += n
    every, of = np.concatenate(texts), np.concatenate(who)
    shared = every["shared"].copy()
    _, back, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared[of[count[back] > 1]] = True
    return every[shared]


def _runs(length: int, gram: int, routes: int, words: int | None):
    def run(batches):
        for b in batches:
            per: dict[int, list[tuple]] = {}
            by_words: dict[int, WordRun] = {}
            keys, ths, ns, copies = (b.column(c).to_pylist() for c in ("key", "th", "n", "copies"))
            wanted = b.column("hs")
            for i, j, buf, off in V.slices(b.column("text")):
                h, p, a, z = anchors(buf, off, length, gram)
                bound, raw = np.searchsorted(p, off), buf.tobytes()
                least, windows, first = word_windows(buf, off, words)
                for d in range(j - i):
                    r = i + d
                    own = slice(bound[d], bound[d + 1])
                    hit = np.flatnonzero(np.isin(h[own], wanted[r].values.to_numpy())) + bound[d]
                    o = int(off[d])
                    for k in hit.tolist():
                        route = int(h[k]) % routes
                        per.setdefault(route, []).append((raw[p[k] : z[k] + length], raw[a[k] : p[k]], 2 if copies[r] > 1 else 1, keys[r], ths[r], ns[r], int(a[k]) - o))
                    lh, lw = least[first[d] : first[d + 1]], windows[first[d] : first[d + 1]] & _FORTY
                    hits = np.flatnonzero(np.isin(lh, wanted[r].values.to_numpy()))
                    # by route and anchor, each window once
                    hits = hits[np.lexsort((lw[hits], lh[hits], lh[hits] % routes))]
                    lh, lw = lh[hits], lw[hits]
                    once = np.flatnonzero(np.r_[True, (lh[1:] != lh[:-1]) | (lw[1:] != lw[:-1])][: len(lh)])
                    lh, lw = lh[once], lw[once]
                    ends = np.r_[np.flatnonzero(np.r_[True, (lh % routes)[1:] != (lh % routes)[:-1]][: len(lh)]), len(lh)].tolist()
                    for x, y in zip(ends, ends[1:]):
                        by_words.setdefault(int(lh[x]) % routes, WordRun()).add((keys[r], ths[r], ns[r]), lh[x:y], lw[x:y])
            out: list[list] = [[], [], []]
            for route, items in per.items():
                items.sort()
                kept, done, k = [], [], 0
                while k < len(items):
                    e = k + 1
                    while e < len(items) and items[e][0] == items[k][0] and items[e][1] == items[k][1]:
                        e += 1
                    if e == k + 1:
                        kept.append(items[k])
                    else:  # equal contexts repeat one another: all their windows are found
                        kept.append((*items[k][:2], 2, *items[k][3:]))
                        done += [(key, th, n, s, s + len(suffix) + len(left)) for suffix, left, weight, key, th, n, s in items[k:e] if weight == 1]
                    k = e
                out[0].append(route)
                out[1].append(encode_run(kept, joined(done)))
                out[2].append(None)
            for route, found in by_words.items():
                out[0].append(route)
                out[1].append(None)
                out[2].append(found.encoded())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["route", "run", "words"])

    return run


def _merge(length: int, gram: int):
    def run(t):
        done, order, shared = [], [], []
        decoded = [decode_run(x) for x in t.column("run").to_pylist() if x is not None]
        for r, k, same in LoserTree([(d[2], d[0]["lcp"].tolist()) for d in decoded]):
            order.append((r, k))
            shared.append(same)
        done = [d[1] for d in decoded]
        if order:
            rs, ks = (np.array(x) for x in zip(*order))
            right = np.array(shared[1:] + [0])
            right = np.maximum(np.r_[0, np.array(shared[1:], np.int64)], right)  # most bytes shared with a neighbour
            items = np.concatenate([decoded[r][0][k : k + 1] for r, k in order])
            texts = [decoded[r][3][k] + decoded[r][2][k] for r, k in order]
            size = np.array([len(x) for x in texts])
            left, weight = items["left"].astype(np.int64), items["weight"].astype(np.int64)
            # windows that reach no further right than a neighbour shares
            count = np.clip(np.minimum(size - length, right - length + left) + 1, 0, None)
            if count.sum():
                at = np.r_[0, np.cumsum(size)[:-1]]
                who = np.repeat(np.arange(len(size)), count)
                o = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
                h = V.Hasher(np.frombuffer(b"".join(texts), np.uint8)).spans(at[who] + o, at[who] + o + length)
                _, back = np.unique(h, return_inverse=True)
                found = (np.bincount(back, weight[who])[back] >= 2) & (weight[who] == 1)
                who, o = who[found], o[found]
                if len(who):
                    new = np.r_[True, (who[1:] != who[:-1]) | (o[1:] != o[:-1] + 1)]
                    last = np.r_[np.flatnonzero(new)[1:] - 1, len(who) - 1]
                    got = np.zeros(int(new.sum()), _DONE)
                    own = items[who[new]]
                    for c in ("key", "th", "n"):
                        got[c] = own[c]
                    got["s"], got["e"] = own["a"] + o[new], own["a"] + o[last] + length
                    done.append(got)
        shared = sharing([x for x in t.column("words").to_pylist() if x is not None])
        marks = np.zeros(len(shared), _DONE)
        for c in ("key", "th", "n"):
            marks[c] = shared[c]
        marks["s"] = marks["e"] = -1
        every = np.concatenate([*done, marks])
        return pa.table({c: np.ascontiguousarray(every[c]) for c in ("key", "th", "n", "s", "e")})

    return run


def _keyed(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)) if "doc_id" in docs.columns else F.lit(_NONE)
    return docs.select(*keep, key.alias("key"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n"), "text")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = ("doc_id",), words: int | None = None) -> DataFrame:
    """``keep``, text, spans: array of (s, e) byte intervals to remove (null for none), which may overlap, and shared: whether
    that many consecutive words stand in another document."""
    spark = docs.sparkSession
    n = parts(spark)
    keyed = _keyed(docs, keep)
    per_doc = written(keyed.select("key", "th", "n", "text").mapInArrow(_grams(length, gram, words), "key long, th long, n long, long boolean, hs array<long>"))
    texts = written(per_doc.groupBy("th", "n").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("hs").alias("hs")))
    grams = texts.select("key", "th", "n", "copies", F.explode("hs").alias("h"))
    # stored, so that both sides of the join are plain shuffles, which are split where a gram is hot
    again = written(grams.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"))
    wanted = written(grams.join(again, "h").groupBy("key", "th", "n", "copies").agg(F.collect_set("h").alias("hs")))
    n_suffixes = wanted.agg(F.coalesce(F.sum(F.size("hs")), F.lit(0))).first()[0]
    routes = max(4 * n, -(-n_suffixes // ROUTE_SUFFIXES))
    by_key = keyed.repartition(n, "key", "th", "n")
    runs = by_key.select("key", "th", "n", "text").join(wanted, ["key", "th", "n"]).mapInArrow(_runs(length, gram, routes, words), "route long, run binary, words binary")
    passages = runs.groupBy("route").applyInArrow(_merge(length, gram), "key long, th long, n long, s long, e long")
    twice = texts.filter("copies > 1").select("th", "n")
    copied = per_doc.filter((F.col("n") >= length) | F.col("long")).select("key", "th", "n", "long").join(twice, ["th", "n"], "left_semi")
    span = lambda s, e: F.struct(F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e"))
    both = F.array(F.when(F.col("n") >= length, span(0, F.col("n"))), F.when(F.col("long"), span(-1, -1)))
    whole = copied.select("key", "th", "n", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("key", "th", "n", "x.s", "x.e")
    spans = passages.unionByName(whole).groupBy("key", "th", "n").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    shared = F.coalesce(F.exists("spans", lambda x: x["s"] < 0), F.lit(False)).alias("shared")
    return by_key.join(spans, ["key", "th", "n"], "left").select(*keep, "text", F.filter("spans", lambda x: x["s"] >= 0).alias("spans"), shared)


def _cut(raw: bytes, spans) -> tuple[bytes, list[list[int]]]:
    if not spans:
        return raw, []
    s, e = (np.array([x[c] for x in spans], np.int64) for c in ("s", "e"))
    runs = merged(s, e)
    ends = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join([raw[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2)]), runs


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = ("doc_id",), words: int | None = None) -> DataFrame:
    """``keep``, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256; with ``words`` also shared, as :func:`repeats` has it."""
    more = ("shared",) if words else ()

    def run(batches):
        for b in batches:
            rows = [_cut((t or "").encode(), s) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            sizes = [len((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array([n - len(k) for n, (k, _) in zip(sizes, rows)], pa.int64()), pa.array([len(r) for _, r in rows], pa.int64()), pa.array([k for k, _ in rows], pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in rows], pa.string()), *(b.column(c) for c in more)],
                names=[*keep, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", *more],
            )

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return repeats(docs, length, gram, keep, words).mapInArrow(run, fields + "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string" + (", shared boolean" if words else ""))


def op3_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"), words=WORDS)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("changed"), F.col("shared").alias("shares_51_words"))
