"""MinHash near-duplicates by an LSH forest.

A text is the set of its ``N``-word shingles; equal sets are one from the start.
``TREES`` trees order the sets by signatures of ``DEPTHS[-1]`` minima each.

1. Regions.  Sets that share a prefix of ``DEPTHS[0]`` minima with another are
   neighbours in the tree's order.  A prefix held by more sets than its depth
   allows (``MOST``) is too dense, so its sets go on by their next minimum.
   Depths are chosen from counts alone: no region meets in one task before it is
   small, and what stays dense at the last depth is one region as it stands.
2. Candidates.  In a region, sets whose signatures agree in ``AGREE`` of all
   minima are candidates; only a spanning forest of them leaves the task.  Its
   components are families: every candidate pair lies within one family, so each
   set travels once, however many trees it shares.
3. Links.  Families are compared on their full sets.  A family of more than
   ``BLOCK`` sets or ``TOKENS`` shingles is dealt out in blocks, and its ``PIVOTS`` smallest sets join
   every block; whatever reaches the threshold with one of them is connected
   without further work.  Only sets that this leaves apart from the largest part
   of their family are then compared with all blocks of it, so the cost follows
   them and not the square of the family.
4. Documents take the smallest doc_id of their component.

Two sets of Jaccard exactly 0.8 are no neighbours in any tree with a chance of
8e-8 in regions of depth 2, 1e-5 at depth 3 and 2e-4 at depth 4; such a pair
has under ``AGREE`` equal minima with one of 3e-7.  More similar pairs are missed
far more rarely.

Defined cases: a null text counts as empty; an empty set is linked with nothing
and its document is its own component; a text of fewer than N words has one
shingle of all of them; repeated rows and equal texts are one set; a null doc_id
is greater than every id, and where a component has no other its component_id is
null and its rows are kept; ids are of any type that has an order; a very long
text is one set of all its shingles; an empty table gives an empty result; extra
columns, whatever their names, are ignored.  Sets and shingles are known by
64-bit hashes, shingles inside tasks by 48 bits of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import BATCH_BYTES, parts, table, written
from .jaccard import _common, components, packed, unpacked

N, THRESHOLD = 2, 0.8
TREES, DEPTHS, MOST = 16, (2, 3, 4), (64, 512)
#: Minima of a signature: those of the trees' orders first.
HASHES, AGREE = 128, 80
#: Sets of one block, and sets that stand in all blocks of their family.
BLOCK, PIVOTS = 1024, 4
#: Shingles of one block, as a mean.
TOKENS = 3_300_000
#: Bits by which the texts are told that no comparison asks for: 8 MB, whatever the corpus.
BITS = 1 << 26
#: Columns that find a set's text: hashes of its id and of itself, and its size.
TEXT = ("row", "th", "bytes")
#: Sets of one region that are compared by signature at once; a larger one is a family as it stands.
REGION = 1024
_RNG = np.random.Generator(np.random.PCG64(12))
_XOR = _RNG.integers(0, 2**64 - 1, HASHES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**64 - 1, HASHES, dtype=np.uint64) | np.uint64(1)


def token_sets(buf: np.ndarray, off: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    low = V.LOWER[buf]
    s, e, doc = V.runs(low, off, V.TOKEN)
    h = V.Hasher(low).spans(s, e)
    g = V.combine(h, n)
    first = V.per_doc(doc, len(off) - 1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        else:
            out.append(V.combine(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The signature of each set, none of which is empty."""
    flat = np.concatenate(sets)
    start = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.empty((len(sets), HASHES), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], start)
    return V.mix(out)


def prefixes(signature: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes of each tree's order at DEPTHS: one row for each set, tree by tree."""
    out = np.empty((len(signature), TREES, len(DEPTHS)), np.uint64)
    last = DEPTHS[-1]
    for t in range(TREES):
        p = np.full(len(signature), t + 1, np.uint64)
        for d in range(last):
            p = V.mix(p * np.uint64(0x9FB21C651E98DF25) ^ signature[:, t * last + d])
            if d + 1 in DEPTHS:
                out[:, t, DEPTHS.index(d + 1)] = p
    return out.reshape(len(signature), -1)


def _sketches(kind: str, n: int):
    def run(batches):
        for b in batches:
            for i, j, buf, off in V.slices(b.column("text")):
                sets = token_sets(buf, off, n)
                some = [k for k, s in enumerate(sets) if len(s)]
                deep: list = [[]] * len(sets)
                sig, ids = [b""] * len(sets), np.zeros(len(sets), np.int64)
                if some:
                    values = minima([sets[k] for k in some])
                    p, low = prefixes(values).astype(np.int64), (values & np.uint64(255)).astype(np.uint8)
                    for r, k in enumerate(some):
                        deep[k], sig[k] = p[r], low[r].tobytes()
                        ids[k] = V.mix(np.array([V.mix(sets[k]).sum(dtype=np.uint64) + np.uint64(len(sets[k]))])).astype(np.int64)[0]
                own = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in ("doc_id", "row", "th", "bytes")), pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array(deep, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["doc_id", "row", "th", "bytes", "set", "n", "deep", "sig"],
                )

    return run, f"doc_id {kind}, row long, th long, bytes long, `set` long, n long, deep array<long>, sig binary"


def rooted(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Labels after the pairs (a, b) are joined: each component has that of its smallest root."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        new = root.copy()
        np.minimum.at(new, x, y)
        np.minimum.at(new, y, x)
        while (new != new[new]).any():
            new = new[new]
        root = new


def alike(sig: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets whose signatures agree often enough, and whose sizes allow the threshold."""
    left, right = [], []
    for a in range(0, len(sig), 64):
        near = (sig[a : a + 64, None, :] == sig[None, :, :]).sum(2, dtype=np.int16) >= AGREE
        near &= np.minimum(size[a : a + 64, None], size) >= threshold * np.maximum(size[a : a + 64, None], size)
        x, y = np.nonzero(near)
        keep = x + a < y
        left.append(x[keep] + a)
        right.append(y[keep])
    return np.concatenate(left), np.concatenate(right)


def _groups(batches, *by: str):
    """Rows of each group of batches that are sorted by group, as lists of columns."""
    held, last, names = [], None, None
    for b in batches:
        names = b.schema.names
        columns = [b.column(c).to_pylist() for c in names]
        for row in zip(*columns):
            key = tuple(row[names.index(c)] for c in by)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def _candidates(threshold: float):
    def run(batches):
        out: list[list[int]] = [[], []]
        for _, rows in _groups(batches, "region"):
            ids = np.array([r[1] for r in rows])
            x, y = alike(np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1), np.array([r[2] for r in rows]), threshold)
            root = rooted(x, y, np.arange(len(rows)))
            k = np.flatnonzero(root != np.arange(len(rows)))
            out[0] += ids[k].tolist()
            out[1] += ids[root[k]].tolist()
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])
                out = [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return run


def connected(sets: list[np.ndarray], root: np.ndarray, threshold: float, sides: np.ndarray | None = None) -> np.ndarray:
    """Labels of the components of the links between sets, from labels that are known to be connected.

    Pairs that already share a label are not compared; with ``sides`` (1: left, 2: right, 3: both) only
    pairs of a left and a right one are.  What is returned is exact.
    """
    size = np.array([len(s) for s in sets])
    start = np.r_[0, np.cumsum(size)[:-1]]
    flat = np.concatenate(sets)
    tried = np.zeros(len(sets), bool)
    for _ in range(8):  # stars first: the smallest set that stands alone, against all others
        alone = np.flatnonzero(~tried & (np.bincount(root, minlength=len(sets))[root] == 1))
        if not len(alone) or (root == root[0]).all():
            break
        p = int(alone[0])
        tried[p] = True
        own = sets[p]
        common = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, start)
        linked = common >= threshold * (size + size[p] - common) - 1e-9
        if sides is not None:
            linked &= ((sides & 1) & (sides[p] >> 1) | (sides >> 1) & (sides[p] & 1)).astype(bool)
        near = np.flatnonzero(linked)
        root = rooted(np.full(len(near), p), near, root)
    left = np.arange(len(sets)) if sides is None else np.flatnonzero(sides & 1)
    right = left if sides is None else np.flatnonzero(sides & 2)
    open_ = root[left][:, None] != root[right][None, :]
    open_ &= np.minimum.outer(size[left], size[right]) >= threshold * np.maximum.outer(size[left], size[right])
    open_ &= ~(tried[left][:, None] | tried[right][None, :])
    if sides is None:
        open_ = np.triu(open_)
    x, y = np.nonzero(open_)
    if not len(x):
        return root
    if len(x) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left[x].tolist(), right[y].tolist())])
    else:
        common = _common(sets, left, right)[x, y]
    x, y = left[x], right[y]
    hit = common >= threshold * (size[x] + size[y] - common) - 1e-9
    return rooted(x[hit], y[hit], root)


def _spread(n: int):
    """Each set to the tasks of its family."""
    names = ["family", "task", "set", "label", "side", "tokens"]
    kinds = (*[pa.int64()] * 5, pa.binary())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    def run(batches):
        rows, held = [[] for _ in kinds], 0
        for b in batches:
            ids, labels, families, to = (b.column(c).to_pylist() for c in ("set", "label", "family", "to"))
            k = 0
            for _, _, buf, off in V.slices(b.column("text")):
                for s in token_sets(buf, off, n):
                    raw = packed(s)
                    for t in to[k]:
                        for c, x in zip(rows, (families[k], t["task"], ids[k], labels[k], t["side"], raw)):
                            c.append(x)
                        held += len(raw)
                        if held > BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [[] for _ in kinds], 0
                    k += 1
        yield batch(rows)

    return run


def _links(threshold: float):
    def run(batches):
        out: list[list[int]] = [[], []]
        for _, rows in _groups(batches, "family", "task"):
            one: dict[int, tuple] = {}
            for r in rows:  # equal rows are one set; a set may stand on both sides
                one[r[2]] = (*r[:4], r[4] | one[r[2]][4], r[5]) if r[2] in one else r
            rows = list(one.values())
            if len(rows) > 1:
                sides = np.array([r[4] for r in rows])
                first: dict[int, int] = {}
                root = np.array([first.setdefault(r[3], k) for k, r in enumerate(rows)])
                new = connected([unpacked(r[5]) for r in rows], root, threshold, None if (sides == 3).all() else sides)
                for k in np.flatnonzero(new != root).tolist():
                    out[0].append(rows[k][3])
                    out[1].append(rows[int(new[k])][3])
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])
                out = [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return run


def _regions(sets: DataFrame) -> DataFrame:
    """(region, set, c, least: its smallest set) of every set with neighbours: at each depth, what is not too dense stays, and the rest goes on."""
    tree = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(*(F.get("deep", t * len(DEPTHS) + d).alias(f"p{d}") for d in range(len(DEPTHS)))))).alias("z")
    rows = sets.select("set", tree).select("set", *(f"z.p{d}" for d in range(len(DEPTHS))))
    out = None
    for d in range(len(DEPTHS)):
        counts = written(rows.groupBy(f"p{d}").agg(F.count(F.lit(1)).alias("c"), F.min("set").alias("least")).filter("c > 1"))
        shared = written(rows.join(counts, f"p{d}"))
        here = shared if d == len(DEPTHS) - 1 else shared.filter(F.col("c") <= MOST[d])
        here = here.select(F.col(f"p{d}").alias("region"), "set", "c", "least")
        out = here if out is None else out.unionByName(here)
        if d < len(DEPTHS) - 1:
            rows = shared.filter(F.col("c") > MOST[d]).select("set", *(f"p{k}" for k in range(d + 1, len(DEPTHS))))
            if counts.filter(F.col("c") > MOST[d]).isEmpty():
                break
    return out


def _families(sets: DataFrame, threshold: float) -> DataFrame:
    """(set, family) of every set that is a candidate with another."""
    n = parts(sets.sparkSession)
    regions = _regions(sets)
    small = regions.filter(F.col("c") <= REGION).groupBy("set").agg(F.collect_list("region").alias("regions"))
    near = sets.select("set", "n", "sig").join(small, "set").select(F.explode("regions").alias("region"), "set", "n", "sig")
    near = near.repartition(n, "region").sortWithinPartitions("region", "set")
    pairs = near.mapInArrow(_candidates(threshold), "a long, b long")
    pairs = pairs.unionByName(regions.filter(F.col("c") > REGION).select(F.col("set").alias("a"), F.col("least").alias("b")))
    return components(pairs).select(F.col("node").alias("set"), F.col("root").alias("family"))


def _asked(docs: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose bit a row of ``of`` has set: all that it names and a few others, so that the rest is not shuffled."""
    bit = F.pmod(F.xxhash64("row", "th"), F.lit(BITS))
    word, place = F.shiftright(bit, 15), bit % 32_768  # bitmaps are of 4 KB
    maps = of.select(word.alias("word"), place.alias("place")).repartition("word").groupBy("word").agg(F.bitmap_construct_agg("place").alias("map"))
    byte = F.conv(F.hex(F.substring("map", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = docs.withColumn("word", word).join(F.broadcast(maps), "word")
    return held.filter(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (place % 8 + 1).cast("int")).cast("long")) != 0).select(*docs.columns)


def _compared(docs: DataFrame, wanted: DataFrame, threshold: float, n: int) -> DataFrame:
    """Edges (a, b) between labels from the tasks of ``wanted`` (set, label, family, row, th, bytes, to: array of task and side)."""
    of = written(wanted)
    # rows that repeat id and text, and rows that are wanted twice, are one set in their task
    full = _asked(docs.select(*TEXT, "text"), of).join(of, [*TEXT]).select("set", "label", "family", "to", "text")
    sent = full.mapInArrow(_spread(n), "family long, task long, `set` long, label long, side long, tokens binary")
    sent = sent.repartition(parts(docs.sparkSession), "family", "task").sortWithinPartitions("family", "task", "set")
    return written(sent.mapInArrow(_links(threshold), "a long, b long"))


def _to(task: Column, side: int) -> Column:
    return F.struct(task.cast("long").alias("task"), F.lit(side).cast("long").alias("side"))


def _blocks(sets: Column, tokens: Column, block: int) -> Column:
    """How many blocks so many sets and shingles take."""
    return F.ceil(F.greatest(sets / block, tokens / TOKENS)).cast("long")


def _block(of: str) -> Column:
    """Which of so many blocks a set is in."""
    return F.pmod(F.xxhash64("set", F.lit(5)), F.col(of))


def _each(count: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)


def _first_links(docs: DataFrame, member: DataFrame, threshold: float, n: int, pivots: int) -> DataFrame:
    """Links within each block of a family, and of all its sets with its pivots."""
    chosen = [F.min(F.struct(F.xxhash64("set", F.lit(100 + k)).alias("o"), F.struct("set", *TEXT).alias("p")))["p"].alias(f"p{k}") for k in range(pivots)]
    pivot = member.filter("g > 1").groupBy("family", "g").agg(*chosen).select("family", "g", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(pivots))))).alias("p")).select("family", "g", "p.*")
    everywhere = pivot.select("set", "family", *TEXT, F.transform(_each("g"), lambda k: _to(k, 3)).alias("to"))
    own = member.select("set", "family", *TEXT, F.array(_to(_block("g"), 3)).alias("to"))
    return _compared(docs, own.unionByName(everywhere).withColumn("label", F.col("set")), threshold, n)


def _rest_links(docs: DataFrame, large: DataFrame, roots: DataFrame, threshold: float, n: int, block: int) -> DataFrame | None:
    """Links of the sets that are apart from the largest part of their family, with all of it; None where there are none."""
    named = large.join(roots.select(F.col("node").alias("set"), F.col("root").alias("label")), "set", "left").withColumn("label", F.coalesce("label", "set"))
    named = written(named)
    part = named.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    main = part.groupBy("family").agg(F.max(F.struct("c", "label", "t")).alias("m"), F.sum("c").alias("c"), F.sum("t").alias("t")).filter("c > m.c")
    main = written(main.select("family", F.col("m.label").alias("main"), _blocks(F.col("c") - F.col("m.c"), F.col("t") - F.col("m.t"), block).alias("r")))
    if main.isEmpty():
        return None
    held = named.join(main, "family")
    right = F.transform(_each("r"), lambda i: _to(i * F.col("g") + _block("g"), 2))
    left = F.transform(_each("g"), lambda j: _to(_block("r") * F.col("g") + j, 1))
    to = F.when(F.col("label") != F.col("main"), F.concat(right, left)).otherwise(right)
    return _compared(docs, held.select("set", "label", "family", *TEXT, to.alias("to")), threshold, n)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document; see the module."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("row"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("bytes"), text.alias("text"))
    run, schema = _sketches(docs.schema["doc_id"].dataType.simpleString(), n)
    sketched = written(rows.mapInArrow(run, schema))
    of = F.min(F.struct("row", "th", "bytes")).alias("of")
    sets = written(sketched.filter("n > 0").groupBy("set", "n").agg(of, F.first("deep").alias("deep"), F.first("sig").alias("sig")).select("set", "n", "of.*", "deep", "sig"))
    sized = written(_families(sets, threshold).join(sets.select("set", "n", *TEXT), "set"))
    size = sized.groupBy("family").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    size = written(size.select("family", _blocks(F.col("c"), F.col("t"), block).alias("g")))
    member = written(sized.join(size, "family"))
    edges = _first_links(rows, member, threshold, n, pivots)
    roots = components(edges)
    rest = _rest_links(rows, member.filter("g > 1"), roots, threshold, n, block)
    named = sketched.select("doc_id", F.col("n").alias("n_shingles"), "set").join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("root", "set").alias("part"))
    if rest is not None:  # these edges are between components, of which there are few
        joined = components(rest).select(F.col("node").alias("part"), "root")
        named = named.join(joined, "part", "left").select("doc_id", "n_shingles", F.coalesce("root", "part").alias("part"))
    named = written(named)
    least = written(named.filter("n_shingles > 0").groupBy("part").agg(F.min("doc_id").alias("least")))
    alone = named.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = named.filter("n_shingles > 0").join(least, "part").select("doc_id", "n_shingles", F.col("least").alias("component_id")).unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The rules on whole tables: all links by shared shingles, components by walking them.
SQL = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM low),
sized AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM met JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM low
  UNION
  SELECT a, y FROM reach JOIN ways ON b = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM low LEFT JOIN sized USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)
"""
