r"""PII: information-theoretic sanitisation.

Base spans (e-mail, IPv4, card, phone) come from fixed patterns.  Then the
corpus tells how strongly other terms reveal the protected entities found:
with n(t) the occurrences of term t in the corpus, n(t, e) those within
``REACH`` words of entity e, n(e) the words around e and n all words,

    disclosure(t, e) = n(t, e) / (n(t) + SMOOTH),   pmi(t, e) = log2(n(t, e) n / (n(t) n(e)))

A term with disclosure of at least ``DISCLOSURE`` and pmi of at least ``BITS``
reveals e, and is marked wherever it occurs: :func:`sanitised` generalises base
spans to their kind and removes revealing terms.  Any word may be a term,
whatever its length or characters; one that occurs solely beside an entity of a
single text reveals it.  Both n(t, e) and n(t) count every row, so copies weigh
the same in both.  A term is counted in the whole corpus only where its count
in the texts in which it stands near some entity leaves it a chance: n(t) is no
less than that.

Counts and terms are compared by 64-bit hashes.  Term tables go to the scans in
blocks of at most ``BLOCK`` hashes, one after another: more terms mean more
passes over the text, never a larger broadcast.

Defined cases: a null or empty text has no spans; a very long text is scanned
whole, in one task; repeated rows are marked alike, each for itself; a null id
is kept; an empty table has no terms and gives an empty result; a kind's spans
never overlap one another but kinds may; extra columns, whatever their names,
are kept by :func:`sanitised` and ignored by the others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import _vec as V
from ._common import table, written

KINDS = ("email", "ip", "card", "phone", "term")
REACH, SMOOTH, DISCLOSURE, BITS = 5, 0.25, 0.75, 8.0
#: Hashes in one broadcast block.
BLOCK = 2_000_000

_LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its start only, which finds the same matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # words as in V.WORD, before lower-casing


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for k, s, e in spans])


def _lower(text: str) -> bytes:
    return bytes(V.LOWER[np.frombuffer(text.encode(), np.uint8)])


def _term_hashes(words: list[str]) -> np.ndarray:
    raw = [_lower(w) for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    off = np.r_[0, np.cumsum([len(w) for w in raw], dtype=np.int64)].astype(np.int64)
    return V.Hasher(buf).spans(off[:-1], off[1:]).astype(np.int64)


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)


def contexts(docs: DataFrame) -> DataFrame:
    """(entity, term, n) hashes and occurrences of the words within REACH words of an entity, and under a null entity those of the same words in the whole text."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], []]
            for text in b.column("text").to_pylist():
                spans = base_spans(text) if text else []
                if not spans:
                    continue
                taken = sorted({(s, e) for _, s, e in spans})
                words = [m for m in _WORDS.finditer(text)]
                if not words:
                    continue
                starts = np.array([m.start() for m in words])
                ends = np.array([m.end() for m in words])
                free = np.ones(len(words), bool)
                for s, e in taken:
                    free[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = False
                hashes = _term_hashes([m[0] for m in words])
                # words near several mentions of an entity count once for it
                near: dict[str, set[int]] = {}
                for kind, s, e in spans:
                    left, right = int(np.searchsorted(ends, s, "right")), int(np.searchsorted(starts, e, "left"))
                    own = [k for k in (*range(max(0, left - REACH), left), *range(right, min(len(words), right + REACH))) if free[k]]
                    near.setdefault(f"{KINDS[kind]}:{text[s:e].lower()}", set()).update(own)
                some = np.array(sorted(set().union(*near.values())), np.int64)
                counted = [(_hash(entity), hashes[sorted(own)]) for entity, own in near.items() if own]
                counted.append((None, hashes[np.isin(hashes, hashes[some])]))
                for entity, terms in counted:
                    term, n = np.unique(terms, return_counts=True)
                    out[0] += [entity] * len(term)
                    out[1] += term.tolist()
                    out[2] += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["entity", "term", "n"])

    return docs.select("text").mapInArrow(run, "entity long, term long, n long")


def _blocks(terms: DataFrame) -> Iterator[np.ndarray]:
    """The column ``term`` as sorted arrays of at most BLOCK hashes; an empty one if there are none."""
    block: list[int] = []
    some = False
    for r in terms.select("term").distinct().toLocalIterator():
        block.append(r[0])
        if len(block) == BLOCK:
            yield np.sort(np.array(block, np.int64))
            block, some = [], True
    if block or not some:
        yield np.sort(np.array(block, np.int64))


def _among(h: np.ndarray, block: np.ndarray) -> np.ndarray:
    return block[np.minimum(np.searchsorted(block, h), len(block) - 1)] == h if len(block) else np.zeros(len(h), bool)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """n(t) of the wanted terms (term, n), and n of all words under a null term; stored."""
    spark = docs.sparkSession

    def counter(shared):
        def run(batches):
            total, found = 0, np.zeros(len(shared.value), np.int64)
            for b in batches:
                for _, _, buf, off in V.slices(b.column("text")):
                    low = V.LOWER[buf]
                    s, e, _ = V.runs(low, off, V.WORD)
                    total += len(s)
                    h = V.Hasher(low).spans(s, e).astype(np.int64)
                    h = h[_among(h, shared.value)]
                    found += np.bincount(np.searchsorted(shared.value, h), minlength=len(found))
            k = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([*shared.value[k].tolist(), None], pa.int64()), pa.array([*found[k].tolist(), total], pa.int64())], names=["term", "n"])

        return run

    every = None
    for k, block in enumerate(_blocks(terms)):
        shared = spark.sparkContext.broadcast(block)
        one = docs.select("text").mapInArrow(counter(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        one = written(one.filter("term is not null") if k else one)
        shared.unpersist()
        every = one if every is None else every.unionByName(one)
    return every


def revealing(docs: DataFrame) -> DataFrame:
    """(term, entity, near, n, disclosure, pmi) of the terms over the thresholds."""
    near = written(contexts(docs).groupBy("entity", "term").agg(F.sum("n").alias("near")))
    around = near.filter("entity is not null").groupBy("entity").agg(F.sum("near").alias("around"))
    least = near.filter("entity is null").select("term", F.col("near").alias("least"))
    pairs = written(near.filter("entity is not null").join(least, "term").filter(F.col("near") / (F.col("least") + SMOOTH) >= DISCLOSURE).drop("least"))
    counts = term_counts(docs, pairs)
    words = counts.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = pairs.join(around, "entity").join(counts.filter("term is not null"), "term")
    pairs = pairs.withColumn("disclosure", F.col("near") / (F.col("n") + SMOOTH)).withColumn("pmi", F.log2(F.col("near") * F.lit(float(words)) / (F.col("n") * F.col("around"))))
    return pairs.filter((F.col("disclosure") >= DISCLOSURE) & (F.col("pmi") >= BITS)).select("term", "entity", "near", "n", "disclosure", "pmi")


def _term_spans(texts: pa.Array, block: np.ndarray) -> list[list[list[int]]]:
    """Code-point spans of the block's terms in each text."""
    out = []
    for i, j, buf, off in V.slices(texts):
        low = V.LOWER[buf]
        s, e, doc = V.runs(low, off, V.WORD)
        hit = np.flatnonzero(_among(V.Hasher(low).spans(s, e).astype(np.int64), block)) if len(s) and len(block) else np.zeros(0, np.int64)
        rows: list[list[list[int]]] = [[] for _ in range(j - i)]
        if len(hit):
            points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
            for k in hit.tolist():
                o = points[off[doc[k]]]
                rows[doc[k]].append([int(points[s[k]] - o), int(points[e[k]] - o)])
        out += rows
    return out


def marked(docs: DataFrame, terms: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep``, base (array of kind number, start, end) and terms (array of start, end, in order) of each text, and the text if wanted.

    Every row goes through one pass for each block of terms and takes its spans along; between passes the rows are stored.
    """
    spark = docs.sparkSession
    pair = pa.list_(pa.list_(pa.int64()))
    kinds = ArrayType(ArrayType(LongType()))

    def marker(shared, first: bool, names: list[str]):
        def run(batches):
            for b in batches:
                text, terms = b.column("text"), _term_spans(b.column("text"), shared.value)
                if first:
                    base = pa.array([[list(x) for x in base_spans(t)] if t else [] for t in text.to_pylist()], pair)
                else:
                    base = b.column("base")
                    terms = [sorted(x + y) for x, y in zip(b.column("terms").to_pylist(), terms)]
                yield pa.RecordBatch.from_arrays([b.column(c) if c not in ("base", "terms") else base if c == "base" else pa.array(terms, pair) for c in names], names=names)

        return run

    rows, blocks = docs.select(*keep, *["text"] * ("text" not in keep)), _blocks(terms)
    block, more = next(blocks), next(blocks, None)
    first = True
    while True:
        last = more is None
        fields = [rows.schema[c] for c in (*keep, *["text"] * ("text" not in keep and (with_text or not last)))]
        out = StructType([*fields, StructField("base", kinds), StructField("terms", kinds)])
        shared = spark.sparkContext.broadcast(block)
        rows = rows.mapInArrow(marker(shared, first, out.names), out)
        if last:
            return rows
        rows = written(rows)
        shared.unpersist()
        first, block, more = False, more, next(blocks, None)


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans generalised to ``[KIND]`` and revealing terms to ``[TERM]``."""
    # whole rows are carried as one column, so that no name of theirs clashes
    rows = marked(docs.select(F.struct("*").alias("row"), "text"), written(revealing(docs)), ("row",), with_text=True)
    kind = docs.schema["text"].dataType

    def run(batches):
        for b in batches:
            out = []
            for t, base, terms in zip(b.column("text").to_pylist(), b.column("base").to_pylist(), b.column("terms").to_pylist()):
                if not t:
                    out.append(t)
                    continue
                spans = sorted([(s, e, KINDS[k]) for k, s, e in base] + [(s, e, "term") for s, e in terms], key=lambda x: (x[0], -x[1]))
                parts, at = [], 0
                for s, e, kind in spans:
                    if s >= at:
                        parts += [t[at:s], f"[{kind.upper()}]"]
                    at = max(at, e)
                out.append("".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    out = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("text", kind)]))
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def _number(kind: int):
    """How many base spans are of this kind; a function of its own, as filter() gives a second parameter the place in the array."""
    return F.size(F.filter("base", lambda x: x[0] == F.lit(kind))).cast("long")


def digests(found: DataFrame) -> DataFrame:
    """n_email .. n_phone, base_sha256 and spans of :func:`marked` rows."""
    name = lambda x: F.concat(F.element_at(F.array(*[F.lit(k) for k in KINDS]), (x[0] + 1).cast("int")), F.lit(":"), x[1].cast("string"), F.lit(":"), x[2].cast("string"))
    base = F.array_join(F.transform("base", name), ",")
    terms = F.transform("terms", lambda x: F.concat(F.lit("term:"), x[0].cast("string"), F.lit(":"), x[1].cast("string")))
    out = found.withColumns({f"n_{n}": _number(k) for k, n in enumerate(KINDS[:4])})
    return out.withColumn("base_sha256", F.sha2(base, 256)).withColumn("spans", F.array_join(F.concat(F.transform("base", name), terms), ","))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = digests(marked(docs, written(revealing(docs))))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
