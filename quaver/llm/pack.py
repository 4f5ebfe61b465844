"""Tokenising and best-fit packing of documents into fixed-length sequences.

Tokenising works on distinct pre-tokens: the byte-level pattern is applied to
whole slices at once in numpy, spans are hashed, and only spans not seen before
by the worker go through the tokenizer.

Packing is exact-complement hashing on the histogram of piece lengths, which
has at most ``capacity`` entries whatever the corpus size: for each length,
longest first, an index of single, pair and triple length sums finds
combinations that exactly fill the gap, consumed as often as all their counts
allow; what remains is packed best-fit.  The driver sees lengths and counts
only.  Pieces then get a rank within their length and take the slot of the plan
that the rank falls in; ranks are numbered per (length, salt), so that a length
holding a third of all pieces is numbered by many tasks.

Defined cases: a null or empty text is one piece of one token (the separator);
a very long text is tokenised whole in one task and cut into full pieces;
repeated rows are packed each, in any order among themselves; ties between
equal lengths go by salt, doc_id and piece; a null id is kept; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _vec as V
from ._common import released, table, written

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Distinct pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 250_000
#: Distinct pre-tokens encoded at once in a slice with too many of them to remember.
CHUNK = 100_000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Endings that the pattern takes together with their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def classes(split: Callable[[str], list]) -> np.ndarray:
    """The class of every code point as the tokenizer itself has it, whatever its version of Unicode: ``split`` gives a text's pre-tokens.

    Characters of one class that follow one of it stay with it, so a whole range of a class is one pre-token; mixed ranges are halved.
    """
    kinds = np.full(0x110000, OTHER, np.uint8)
    todo = [range(c, c + 4096) for c in range(0, 0x110000, 4096) if not 0xD000 <= c < 0xE000] + [range(0xD000, 0xD800)]
    while todo:
        own = todo.pop()
        text = "".join(map(chr, own))
        kind = next((k for k, lead in ((OTHER, "!"), (LETTER, "a"), (NUMBER, "1")) if len(split(lead + text)) == 1), None)
        if kind is not None or len(own) == 1:
            kinds[own.start : own.stop] = SPACE if kind is None else kind
        else:
            half = own.start + len(own) // 2
            todo += [range(own.start, half), range(half, own.stop)]
    return kinds


def pretokens(buf: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pre-tokens of the byte-level pattern start, and their document numbers."""
    # code points and the bytes at which they start
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    if not len(at):
        return at, at
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = kinds[cp]
    doc0 = np.searchsorted(at, off[:-1])  # first code point of each document
    doc0 = doc0[np.diff(off) > 0]
    n = len(cp)
    begins = np.zeros(n + 1, bool)
    begins[0] = begins[n] = True
    begins[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[doc0] = edge[n] = True
    begins |= edge
    s = np.flatnonzero(begins)
    s, e = s[:-1], s[1:]
    start = begins[:n].copy()
    # a run of white space gives its last character to what follows in the same document
    space = kind[s] == SPACE
    ws, we = s[space], e[space]
    inner = ~edge[we]
    ws, we = ws[inner], we[inner]
    start[we - 1] = True
    start[we[cp[we - 1] == 0x20]] = False
    # contractions: an apostrophe that starts a pre-token and is followed by one of the endings
    quote = s[(cp[s] == 0x27) & (e - s == 1)]
    quote = quote[start[quote] & (quote + 1 < n)]
    quote = quote[~edge[quote + 1]]
    for q in quote.tolist():
        end = int(np.searchsorted(doc0, q, "right"))
        end = int(doc0[end]) if end < len(doc0) else n
        tail = "".join(map(chr, cp[q + 1 : min(q + 3, end)].tolist()))
        for c in CONTRACTIONS:
            if tail.startswith(c):
                start[q + 1] = False
                if q + 1 + len(c) < n:
                    start[q + 1 + len(c)] = True
                break
    place = at[np.flatnonzero(start)]
    return place, np.searchsorted(off, place, "right") - 1


def _byte_pieces(path: str) -> Callable[[bytes], list[int]] | None:
    """A faster coder of one pre-token, for files whose ids follow their merges; None for others."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # the letters that stand for bytes: printable ones for themselves, the rest moved above U+00FF in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Encoder:
    """ids of texts by a byte-level tokenizer file, remembering distinct pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _byte_pieces(path)
        self.kinds = classes(self.tokenizer.pre_tokenizer.pre_tokenize_str)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.which = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        if len(self.known) + len(hashes) > REMEMBERED:
            self.forget()
        found = self._model(texts)
        n0 = len(self.first) - 1
        self.first = np.r_[self.first, self.first[-1] + np.cumsum([len(x) for x in found])]
        self.ids = np.r_[self.ids, np.fromiter((i for x in found for i in x), np.uint32)]
        at = np.searchsorted(self.known, hashes)
        self.known, self.which = np.insert(self.known, at, hashes), np.insert(self.which, at, n0 + np.arange(len(hashes)))

    def _model(self, texts: list[bytes]) -> list[list[int]]:
        if self.pieces is not None:
            return list(map(self.pieces, texts))
        return [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def slice(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all the slice's documents, and where each document's ids start."""
        place, doc = pretokens(buf, off, self.kinds)
        h = V.Hasher(buf).spans(place, np.r_[place[1:], len(buf)]) if len(place) else np.zeros(0, np.uint64)
        distinct, sample, back = np.unique(h, return_index=True, return_inverse=True)
        if len(distinct) > REMEMBERED // 2:
            return self._unremembered(buf, off, place, doc, sample, back)
        if not len(self.known):
            new = np.arange(len(distinct))
        else:
            new = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)] != distinct)
        if len(new):
            end = np.r_[place[1:], len(buf)]
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
                new = np.arange(len(distinct))
            raw = buf.tobytes()
            self._learn(distinct[new], [raw[a:z] for a, z in zip(place[sample[new]].tolist(), end[sample[new]].tolist())])
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        entry = self.which[np.searchsorted(self.known, distinct)][back]
        count = self.first[entry + 1] - self.first[entry]
        total = np.r_[0, np.cumsum(count)]
        ids = self.ids[np.repeat(self.first[entry] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(doc, np.arange(len(off)))]

    def _unremembered(self, buf: np.ndarray, off: np.ndarray, place: np.ndarray, doc: np.ndarray, sample: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slice's result without the memory of pre-tokens: its distinct ones are encoded in chunks."""
        end, raw = np.r_[place[1:], len(buf)], buf.tobytes()
        sizes, chunks = [], []
        for k in range(0, len(sample), CHUNK):
            own = sample[k : k + CHUNK]
            found = self._model([raw[a:z] for a, z in zip(place[own].tolist(), end[own].tolist())])
            sizes.append(np.fromiter(map(len, found), np.int64))
            chunks.append(np.fromiter((i for x in found for i in x), np.uint32))
        size, known = np.concatenate(sizes), np.concatenate(chunks)
        first = np.cumsum(size) - size
        count = size[back]
        total = np.r_[0, np.cumsum(count)]
        return known[np.repeat(first[back] - total[:-1], count) + np.arange(total[-1])], total[np.searchsorted(doc, np.arange(len(off)))]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """ids of each text; texts that hold a special token's string go through the tokenizer whole."""
        for i, j, buf, off in V.slices(column):
            raw = buf.tobytes()
            ids, first = self.slice(buf, off)
            odd = any(s.encode() in raw for s in self.special)
            for k in range(j - i):
                text = raw[off[k] : off[k + 1]] if odd else b""
                if odd and any(s.encode() in text for s in self.special):
                    yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[first[k] : first[k + 1]]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, path: str | None = None, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: keys, piece, start, length, ids_crc32 (and ids). Longer documents are cut; their first piece holds the rest."""

    def run(batches):
        enc = encoder(path or default_path())
        for b in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for r, ids in enumerate(enc.texts(b.column("text"))):
                ids = np.append(ids, np.uint32(separator)).astype("<u4")
                head = len(ids) % capacity or min(len(ids), capacity)
                s = 0
                for k, e in enumerate(range(head, len(ids) + 1, capacity)):
                    row.append(r)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e]))
                    if with_ids:
                        kept.append(ids[s:e].tolist())
                    s = e
            take = pa.array(row, pa.int64())
            columns = [b.column(k).take(take) for k in keys] + [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int64()))] * with_ids, names=[*keys, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
        released()

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{fields}, {PIECES}" + ", ids array<long>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that fill one sequence each, with how many sequences take them."""
    left = Counter({k: v for k, v in counts.items() if v > 0})
    if any(k < 1 or k > capacity for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        times = min(left[k] // v for k, v in need.items())
        if times:
            for k, v in need.items():
                left[k] -= v * times
            out.append((pattern, times))

    # exact complements: one, two or three further pieces that fill the gap
    for big in sorted(left, reverse=True):
        gap = capacity - big
        if gap == 0:
            consume((big,))
            continue
        if left[big] and left[gap]:
            consume((big, gap))
        if left[big]:
            for a in range(min(gap - 1, big), (gap - 1) // 2, -1):
                if left[a] and left[gap - a]:
                    consume((big, a, gap - a))
                    if not left[big]:
                        break
        if left[big]:
            lengths = np.array(sorted((k for k, v in left.items() if v and k <= min(gap, big)), reverse=True), np.int64)
            present = np.zeros(capacity + 1, bool)
            present[lengths] = True
            for a in lengths.tolist():
                if not left[big]:
                    break
                if not left[a] or gap - a < 2:
                    continue
                second = lengths[(lengths <= a) & (lengths < gap - a)]
                third = gap - a - second
                for b in second[(third <= second) & present[third]].tolist():
                    if left[a] and left[b] and left[gap - a - b]:
                        consume((big, a, b, gap - a - b))
                        if not left[big]:
                            break
    # best fit of the rest, many equal sequences at a time
    for big in sorted((k for k, v in left.items() if v), reverse=True):
        while left[big] > 0:
            pattern, gap = [big], capacity - big
            used = Counter(pattern)
            while gap:
                fit = next((k for k in range(min(gap, big), 0, -1) if left[k] > used[k]), None)
                if fit is None:
                    break
                pattern.append(fit)
                used[fit] += 1
                gap -= fit
            consume(tuple(pattern))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: rank from which a slot counts, its first sequence, its offset there, and its share of a sequence."""
    rows, sequence, taken = [], 0, Counter()
    for pattern, times in patterns:
        offset, i = 0, 0
        need = Counter(pattern)
        for length in dict.fromkeys(pattern):
            rows.append((length, taken[length], sequence, offset, need[length]))
            taken[length] += times * need[length]
            offset += length * need[length]
        sequence += times
    rows.sort()
    return {k: np.array(v, np.int64) for k, v in zip(("length", "rank", "sequence", "offset", "share"), zip(*rows) if rows else ((),) * 5)}


def salts_of(n: int) -> int:
    """Salts of a length that ``n`` pieces have: up to 64 for a thousand pieces each, more for a quarter million each."""
    return max(1, min(64, -(-n // 1000)), -(-n // 250_000))


def pack(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``items`` (with a ``length`` from 1 to capacity) plus sequence_id and offset. ``items`` must be a stored table, as it is read more than once."""
    spark = items.sparkSession
    total = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    dealt = spark.createDataFrame([(k, salts_of(v)) for k, v in total.items()], "length long, _salts long")
    salted = items.join(F.broadcast(dealt), "length").withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts"))).select(*items.columns, "_salt")
    counts = written(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")))
    plan_ = spark.sparkContext.broadcast(slots(plan(total, capacity)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # at most 64 x capacity rows and one for each 250,000 pieces
    own = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(base), ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_base")).drop("_own", "_base", "_salt")
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches):
        p = plan_.value
        key = p["length"] * (1 << 48) + p["rank"]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            k = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            within = rank - p["rank"][k]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(p["sequence"][k] + within // p["share"][k]), pa.array(p["offset"][k] + within % p["share"][k] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(written(pieces(docs, capacity=capacity, path=path)), capacity)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
