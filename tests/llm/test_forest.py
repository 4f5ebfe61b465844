"""Near duplicates by an LSH forest against a plain version of the rules."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quaver.llm import _common, forest, jaccard
from quaver.llm import _vec as V

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by all pairs and a walk; a null id is the greatest."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        own = least.get(find(k))
        least[find(k)] = i if own is None else own if i is None else min(own, i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least[find(k)] if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def edited(words, rng, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def fixture():
    """Families that hang together by chains and by stars, copies, bystanders, and the edge cases."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    rows = []
    for family in range(3):
        chain = [word() for _ in range(80)]
        for _ in range(14):
            rows.append((len(rows), " ".join(chain)))
            chain = edited(chain, rng, 3)
        star = [word() for _ in range(60)]
        rows += [(len(rows) + k, " ".join(edited(star, rng, 1))) for k in range(12)]
    rows += [(len(rows) + k, " ".join(word() for _ in range(rng.randrange(1, 90)))) for k in range(40)]
    same = "One two\tthree four"
    rows += [(900, same), (900, same), (None, same.upper()), (901, None), (901, ""), (None, None), (None, " \n"), (902, "single"), (903, "SINGLE"), (None, "only null"), (None, "only null"), (904, "É\x0bé"), (905, " ".join(word() for _ in range(20_000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, pivots, tokens", [(forest.BLOCK, forest.PIVOTS, forest.TOKENS), (4, 1, 100)])
def test_components_against_all_pairs(spark, monkeypatch, block, pivots, tokens):
    """Also with families dealt out in blocks of two sets and a hundred shingles, which chains cross."""
    monkeypatch.setattr(forest, "TOKENS", tokens)
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], "doc_id long, text string, `set` string, row string, n string, part string").repartition(5)
    got = forest.near_duplicates(docs, block=block, pivots=pivots)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_text_ids_and_empty_table(spark):
    docs = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), ("c", "four five")], "doc_id string, text string")
    assert sorted(map(tuple, forest.near_duplicates(docs).collect())) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 1, "c", True)]
    assert forest.near_duplicates(docs.limit(0)).collect() == []


def test_regions_leave_dense_prefixes(spark, monkeypatch):
    """With tiny limits most regions lie at the last depth; no pair of equal prefixes is lost there."""
    monkeypatch.setattr(forest, "MOST", (2, 3))
    rng = random.Random(5)
    base = [f"w{rng.randrange(200)}" for _ in range(100)]
    texts = [" ".join(edited(base, rng, 1)) for _ in range(30)]
    run, schema = forest._sketches("bigint", forest.N)
    docs = spark.createDataFrame([(k, k, k, k, t) for k, t in enumerate(texts)], "doc_id long, row long, th long, bytes long, text string")
    sets = docs.mapInArrow(run, schema)
    rows = sets.select("set", "deep").collect()
    regions = forest._regions(sets).collect()
    assert max(r.c for r in regions) > 3
    held = {}
    for r in regions:
        held.setdefault(r.region, set()).add(r.set)
    deep = len(forest.DEPTHS)
    for t in range(forest.TREES):
        last = {}
        for r in rows:
            last.setdefault(r.deep[t * deep + deep - 1], set()).add(r.set)
        for region, members in last.items():
            if len(members) > 1:
                assert any(members <= h for h in held.values())


def test_texts_that_no_comparison_asks_for_stay(spark):
    """All rows that are asked for pass, and next to no others."""
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS row", "xxhash64(id, 1) AS th", "id AS bytes", "CAST(id AS string) AS text")
    for wanted in ("bytes % 50 = 0", "false"):
        of = rows.filter(wanted).select("row", "th", "bytes")
        got = forest._asked(rows, of)
        asked = {r.bytes for r in of.collect()}
        passed = {r.bytes for r in got.collect()}
        assert got.columns == rows.columns and asked <= passed and len(passed) <= len(asked) + 20


def test_pairs_at_the_threshold_are_neighbours():
    """Random pairs of Jaccard 0.8 share a prefix of four minima in some tree, and agree in enough minima."""
    rng = np.random.default_rng(8)
    missed = below = 0
    for _ in range(400):
        x = rng.integers(0, 2**63, 360, dtype=np.uint64)
        pair = [np.unique(x[:324]), np.unique(np.r_[x[:288], x[324:]])]  # 288 shared of 360
        sig = forest.minima(pair)
        p = forest.prefixes(sig).reshape(2, forest.TREES, -1)
        missed += not (p[0] == p[1])[:, -1].any()
        below += int(((sig & np.uint64(255))[0] == (sig & np.uint64(255))[1]).sum() < forest.AGREE)
    assert missed <= 2 and below == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_against_a_walk(spark, seed):
    """Chains, stars around large and small ids, repeated edges, loops, negative ids."""
    rng = random.Random(seed)
    ids = rng.sample(range(-500, 500), 300)
    edges = [(a, b) for a, b in zip(ids[:40], ids[1:40])]
    edges += [(max(ids[40:80]), k) for k in ids[40:80]] + [(min(ids[80:120]), k) for k in ids[80:120]]
    edges += [tuple(rng.sample(ids[120:], 2)) for _ in range(100)]
    edges += edges[::3] + [(b, a) for a, b in edges[::4]] + [(600, 600)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(root.items())


def test_stars_take_no_round(spark):
    """What is settled is seen from one aggregation: no round confirms it, and nothing is written for the roots."""
    for edges, tables in (([(9, 1), (1, 8), (7, 2), (7, 2)], 2), ([(3, 1), (3, 2)], 4), ([], 2)):
        before = len(_common.made)
        got = jaccard.components(spark.createDataFrame(edges, "a long, b long"))
        assert len(_common.made) - before == tables
        assert sorted(map(tuple, got.collect())) == {2: [(1, 1), (2, 1), (3, 1)], 4: [(1, 1), (2, 2), (7, 2), (8, 1), (9, 1)]}.get(len(edges), [])


@pytest.mark.parametrize("seed", range(8))
def test_connected_is_exact(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 2**40, 60, dtype=np.uint64) for _ in range(3)]
    sets = []
    for k in range(60):
        x = base[k % 3].copy()
        x[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(0, 2**40, dtype=np.uint64)
        sets.append(np.unique(x))
    root = np.arange(60)
    sides = rng.integers(1, 4, 60) if seed % 2 else None
    want = root.copy()
    plain = [set(s.tolist()) for s in sets]
    for i in range(60):
        for j in range(i):
            both = len(plain[i] & plain[j])
            meet = sides is None or (sides[i] & 1 and sides[j] & 2) or (sides[i] & 2 and sides[j] & 1)
            if meet and 100 * both >= 80 * (len(plain[i]) + len(plain[j]) - both):
                a, b = sorted((want[i], want[j]))
                want[want == b] = a
    got = forest.connected(sets, root, 0.8, sides)
    same = lambda r: r[:, None] == r[None, :]
    assert (same(got) == same(want)).all()


def test_token_sets():
    texts = pa.array(["A b a B", "x", "", None, "é\x0bÉ é\x0bÉ"], pa.string())
    got = [len(s) for _, _, buf, off in V.slices(texts) for s in forest.token_sets(buf, off)]
    assert got == [2, 1, 0, 0, 2]
