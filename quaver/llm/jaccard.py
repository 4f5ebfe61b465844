"""N-gram Jaccard join by chosen paths.

A text is the set of its ``N``-word shingles.  In each of ``RUNS`` runs a set
walks a tree: at every node it follows the shared tokens whose hash with the
node falls under ``FAN / |set|``, so similar sets choose the same children.
Sets at the same second-level node form a bucket; buckets over ``SPLIT`` sets
recurse once more, unless their children together would cost more comparisons.  A pair of Jaccard 0.8 survives one run with probability of
at least 0.72 (0.68 where it recurses), so eight runs miss it with one chance in ten thousand
or less, and more similar pairs far more rarely.

Buckets are brute-forced exactly.  Buckets with the same members are the same
bucket; each pair counts in the smallest bucket it has in common; larger ones
are dealt out as pairs of blocks of ``BLOCK`` sets and ``TOKENS`` shingles.  Only link counts and a
spanning forest leave a task, never pairs.  Classes are connected components by
alternating stars over written tables.

Equal texts are one set from the start.  Result: a row for each document with
class_id (smallest doc_id of its class), n_links (other documents of Jaccard
>= threshold, copies included) and copies (documents of equal text).

Defined cases: a null text counts as empty; a text of fewer than N words has one
shingle of all of them; one without words links to equal texts only; repeated
rows are copies; a null doc_id sorts before all others and gives a null
class_id; a very long text is one set of all its shingles, cut into ranges of
values where it is compared; an empty table gives an empty result; ids are
whole numbers; extra columns, whatever their names, are ignored (kept by
:func:`representatives`).  Texts and shingles are compared by 64-bit hashes,
sets inside tasks by 48 bits of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _vec as V
from ._common import BATCH_BYTES, free, parts, table, written

N, THRESHOLD = 5, 0.8
RUNS, FAN = 8, 2.0
SPLIT, BLOCK = 512, 1536
#: Shingles in one block at most, as a mean, and values compared at once.
TOKENS, FLAT = 3_300_000, 500_000
_NONE = -(1 << 63)
_SEEDS = V.mix(np.arange(1, 1 + 64, dtype=np.uint64))


def shingles(texts: pa.Array, n: int = N):
    """The sorted distinct shingle hashes of each text."""
    for i, j, buf, off in V.slices(texts):
        low = V.LOWER[buf]
        s, e, doc = V.runs(low, off, V.WORD)
        h = V.Hasher(low).spans(s, e)
        g = V.combine(h, n)
        first = V.per_doc(doc, j - i)
        for d in range(j - i):
            a, b = first[d], first[d + 1]
            if b - a >= n:
                yield np.unique(g[a : b - n + 1])
            elif b > a:
                yield V.combine(h[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _chosen(tokens: np.ndarray, nodes: np.ndarray, fan: float) -> tuple[np.ndarray, np.ndarray]:
    """(node index, child id) of the children that a set follows."""
    limit = np.uint64(min(2**64 - 1, int(fan / len(tokens) * 2**64)))
    with np.errstate(over="ignore"):
        x = (tokens[:, None] ^ nodes[None, :]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
    t, k = np.nonzero(x <= limit)
    return k, V.mix(tokens[t] ^ V.mix(nodes[k]))


def paths(tokens: np.ndarray, runs: int = RUNS, fan: float = FAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second-level nodes, and third-level nodes with the index of their parent."""
    if not len(tokens):
        z = np.zeros(0, np.uint64)
        return z, z, z.astype(np.int64)
    _, one = _chosen(tokens, _SEEDS[:runs], fan)
    _, two = _chosen(tokens, np.unique(one), fan)
    two = np.unique(two)
    parent, three = _chosen(tokens, two, fan)
    three, at = np.unique(three, return_index=True)
    return two, three, parent[at]


def _walk(runs: int, fan: float, n: int):
    def run(batches):
        for b in batches:
            size, two, three, parent = [], [], [], []
            for s in shingles(b.column("text"), n):
                p = paths(s, runs, fan)
                size.append(len(s))
                two.append(p[0].astype(np.int64))
                three.append(p[1].astype(np.int64))
                parent.append(p[0][p[2]].astype(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (two, three, parent)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("th"), b.column("n"), pa.array(size, pa.int64()), *lists], names=["key", "th", "n", "size", "two", "three", "parent"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("key"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))


def packed(tokens: np.ndarray) -> bytes:
    """The low 48 bits of each hash, sorted: two sets of a million shingles agree in one by chance with 4e-3, of a thousand with 4e-9."""
    low = np.unique(tokens & np.uint64(2**48 - 1)).astype("<u8")
    return low.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _spread(n: int):
    """Each set to the tasks of its buckets."""

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["bucket", "task", "part", "key", "copies", "buckets", "tokens"])

    def run(batches):
        """A text leaves once for each bucket, so that what leaves is cut by its own bytes."""
        rows, held, seen = [[] for _ in kinds], 0, set()
        for b in batches:
            # rows of one id and text are one set
            fresh = []
            for key in b.column("key").to_pylist():
                fresh.append(key not in seen)
                seen.add(key)
            b = b.filter(pa.array(fresh, pa.bool_()))
            keys, copies, buckets, groups = (b.column(c).to_pylist() for c in ("key", "copies", "buckets", "groups"))
            for r, s in enumerate(shingles(b.column("text"), n)):
                raw = packed(s)
                ids = np.array(sorted(buckets[r]), "<i8").tobytes()
                for bucket, g in zip(buckets[r], groups[r]):
                    own = (keys[r] * 0x9E3779B97F4A7C15 % 2**64 >> 32) % g
                    for other in range(g):
                        for c, x in zip(rows, (bucket, min(own, other) * g + max(own, other) if own != other else -1 - own, own, keys[r], copies[r], ids, raw)):
                            c.append(x)
                        held += len(ids) + len(raw)
                        if held > BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [[] for _ in kinds], 0
        yield batch(rows)

    return run


def linked(sets: list[np.ndarray], others: list[np.ndarray], bucket: int, part: np.ndarray | None, threshold: float) -> np.ndarray:
    """Pairs (i, j) that this task of the bucket owns and whose Jaccard reaches the threshold; ``part`` tells two blocks apart."""
    size = np.array([len(s) for s in sets])
    left = np.arange(len(sets)) if part is None else np.flatnonzero(part == part.min())
    right = left if part is None else np.flatnonzero(part != part.min())
    own = np.minimum.outer(size[left], size[right]) >= threshold * np.maximum.outer(size[left], size[right])
    if part is None:
        own = np.triu(own, 1)
    before = [o[o < bucket] for o in others]
    if own.any() and any(len(o) for o in before):
        own &= ~(_common(before, left, right) > 0)
    x, y = np.nonzero(own)
    if not len(x):
        return np.zeros((0, 2), np.int64)
    if len(x) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left[x].tolist(), right[y].tolist())])
    else:
        common = _common(sets, left, right)[x, y]
    pairs = np.stack([left[x], right[y]], 1)
    return pairs[common >= threshold * (size[pairs].sum(1) - common) - 1e-9]


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left and right sets, from incidence matrices of the values that occur more than once.

    The sets are sorted, so ranges of values are looked at one after another: memory follows FLAT, not the bucket.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    ranges = -(-sum(len(s) for s in sets) // FLAT)
    least, most = (int(f([f(s) for s in sets if len(s)], default=0)) for f in (min, max))
    edges = [least + (most + 1 - least) * k // ranges for k in range(ranges + 1)] if ranges else []
    at = np.array([np.searchsorted(s, np.array(edges[:-1], s.dtype)).tolist() + [len(s)] for s in sets]) if ranges else np.zeros((len(sets), 1), int)
    for k in range(ranges):
        flat = np.concatenate([s[a:b] for s, a, b in zip(sets, at[:, k].tolist(), at[:, k + 1].tolist())])
        row = np.repeat(np.arange(len(sets)), at[:, k + 1] - at[:, k])
        _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[back] > 1
        column, row = (np.cumsum(count > 1) - 1)[back[keep]], row[keep]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        width = 2048
        for a in range(0, int((count > 1).sum()), width):
            m = np.zeros((len(sets), width), np.float32)
            own = slice(*np.searchsorted(column, [a, a + width]))
            m[row[own], column[own] - a] = 1
            out += m[left] @ m[right].T
    return out


def _brute(threshold: float):
    def run(batches):
        """Rows arrive sorted by bucket, task and set."""
        held, last = [], None
        out = [[], [], []]
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "task", "part", "key", "copies", "buckets", "tokens"))):
                if r[:2] != last:
                    solve(held, threshold, out)
                    held, last = [], r[:2]
                # equal rows may come from several tasks; sorted by set, they follow one another and are not held
                if not held or held[-1][3] != r[3]:
                    held.append(r)
            if len(out[0]) > 10_000:
                yield batch(out)
                out = [[], [], []]
        solve(held, threshold, out)
        yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "links", "root"])

    return run


def solve(rows: list[tuple], threshold: float, out: list[list]) -> None:
    """Link weights and the root of each linked set of one task."""
    if len(rows) < 2:
        return
    rows.sort(key=lambda r: r[3])
    pairs = linked([unpacked(r[6]) for r in rows], [np.frombuffer(r[5], "<i8") for r in rows], rows[0][0], np.array([r[2] for r in rows]) if rows[0][1] >= 0 else None, threshold)
    if not len(pairs):
        return
    copies = np.array([r[4] for r in rows])
    links = np.bincount(pairs[:, 0], copies[pairs[:, 1]], minlength=len(rows)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], minlength=len(rows))
    root = np.arange(len(rows))
    while True:  # labels fall to the smallest of the component
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], root[pairs[:, 0]])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    for k in np.flatnonzero(links).tolist():
        out[0].append(rows[k][3])
        out[1].append(int(links[k]))
        out[2].append(rows[int(root[k])][3])


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): alternating large and small stars."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that both sides of the join are plain shuffles, which are split where a node is hot
        near = written(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")))
        # all are stars where every node has larger neighbours only, or a single one
        if near.filter("m < u AND m < x").isEmpty():
            return near.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        large = now.join(near.select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "v").select("u", F.col("m").alias("v"))
        # every edge becomes one at most, so tables never grow
        small = large.repartition("u").distinct().withColumn("m", F.min("v").over(Window.partitionBy("u")))
        now = written(small.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")))
    raise RuntimeError("components did not settle")


def joined(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, runs: int = RUNS, fan: float = FAN, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """(key, th, n, class_key, n_links, copies) of each document; see the module for the columns of the query."""
    keyed = _keyed(docs)
    walked = keyed.mapInArrow(_walk(runs, fan, n), "key long, th long, n long, size long, two array<long>, three array<long>, parent array<long>")
    texts = written(walked.groupBy("th", "n").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("two").alias("two"), F.first("three").alias("three"), F.first("parent").alias("parent")))
    # texts, not keys, tell sets apart: rows of one id may differ in text
    sets = texts.select(F.xxhash64("th", "n", "key").alias("set"), "size", "two", "three", "parent")
    mark = lambda salt: F.sum(F.shiftright(F.xxhash64("set", F.lit(salt)), 24))
    sized = lambda df: df.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("tokens"), mark(1).alias("s1"), mark(2).alias("s2")).filter("c > 1")
    two = sets.select("set", "size", F.explode("two").alias("bucket"))
    stats2 = written(sized(two))
    over = stats2.filter(F.col("c") > split).select(F.col("bucket").alias("parent"))
    three = sets.select("set", "size", F.explode(F.arrays_zip("three", "parent")).alias("z")).select("set", "size", F.col("z.three").alias("bucket"), F.col("z.parent").alias("parent"))
    three = written(three.join(over, "parent", "left_semi"))
    stats3 = sized(three)
    # near copies stay together below: such a bucket is cheaper whole
    below = stats3.join(three.select("bucket", "parent").distinct(), "bucket").groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("cost"))
    judged = stats2.join(below.withColumnRenamed("parent", "bucket"), "bucket", "left")
    whole = (F.col("c") <= split) | (F.coalesce("cost", F.lit(0)) >= F.col("c") * F.col("c"))
    divided = judged.filter(~whole).select(F.col("bucket").alias("parent"))
    three = written(three.join(divided, "parent", "left_semi").select("set", "size", "bucket"))
    stats = judged.filter(whole).drop("cost").unionByName(sized(three))
    kept = written(stats.groupBy("c", "s1", "s2").agg(F.min("bucket").alias("bucket"), F.max("tokens").alias("tokens")).select("bucket", F.ceil(F.greatest(F.col("c") / block, F.col("tokens") / TOKENS)).cast("long").alias("g")))
    members = two.unionByName(three).drop("size").join(kept, "bucket")
    per_set = members.groupBy("set").agg(F.collect_set(F.struct("bucket", "g")).alias("bs"))
    wanted = written(texts.select("th", "n", "key", "copies", F.xxhash64("th", "n", "key").alias("set")).join(per_set, "set").select("th", "n", "key", "copies", F.col("bs.bucket").alias("buckets"), F.col("bs.g").alias("groups"), "set"))
    # equal rows of a wanted text become one set in _spread and _brute
    full = keyed.join(wanted, ["key", "th", "n"]).select(F.col("set").alias("key"), "copies", "buckets", "groups", "text")
    tasks = full.mapInArrow(_spread(n), "bucket long, task long, part long, key long, copies long, buckets binary, tokens binary")
    tasks = tasks.repartition(4 * parts(docs.sparkSession), "bucket", "task").sortWithinPartitions("bucket", "task", "key")
    links = written(tasks.mapInArrow(_brute(threshold), "key long, links long, root long"))
    named = texts.select(F.xxhash64("th", "n", "key").alias("set"), "th", "n", "key", "copies")
    count = links.groupBy(F.col("key").alias("set")).agg(F.sum("links").alias("links"))
    ids = written(named.join(count, "set").select("set", "key", "links", "th", "n"))
    # edges between the smallest ids of the texts; texts that share an id share their class
    edges = links.select("key", "root").join(ids.select(F.col("set").alias("key"), F.col("key").alias("a")), "key").join(ids.select(F.col("set").alias("root"), F.col("key").alias("b")), "root").select("a", "b")
    roots = components(edges)
    classed = texts.select("th", "n", "key", "copies").join(ids.select("th", "n", "links"), ["th", "n"], "left").join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    classed = written(classed.select("th", "n", "copies", F.coalesce("root", "key").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # hashing the texts once more is cheaper than a table of all their paths
    return keyed.select("key", "th", "n").join(classed, ["th", "n"])


def classes(docs: DataFrame, **how) -> DataFrame:
    out = joined(docs, **how)
    return out.select(F.when(F.col("key") != _NONE, F.col("key")).alias("doc_id"), F.when(F.col("class_key") != _NONE, F.col("class_key")).alias("class_id"), "n_links", "copies")


def representatives(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with their own columns: of each class, the document whose doc_id names it."""
    key, th, n = (free(c, docs.columns) for c in ("_key", "_th", "_n"))
    named = joined(docs, **how).filter("key = class_key").select(F.col("key").alias(key), F.col("th").alias(th), F.col("n").alias(n)).distinct()
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)), th: F.xxhash64(text), n: F.octet_length(text).cast("long")})
    return rows.join(named, [key, th, n], "left_semi").dropDuplicates([key, th, n]).select(*docs.columns)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
