"""Whole queries and stages against plain versions of their own rules, on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaver.llm import _vec as V
from quaver.llm import decontaminate, jaccard, language_model, pack, pii, quality, secrets, substrings, toxicity, winnow

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def words(text):
    return WORDS.findall((text or "").translate(LOW))


#: Columns that bear the names of helpers and results.
CLASHING = ("_key", "_th", "_n", "_row", "_between", "_found", "_matches", "_seen", "_made", "_salt", "base", "terms", "row", "score", "key", "length")


@pytest.fixture(scope="module")
def clashing(spark):
    """Nulls, empty and long texts, ties, repeated rows, and a clash with every helper column."""
    base = prose(90, 21)
    texts = [(1, None), (2, ""), (3, base), (4, base), (4, base), (None, base + " Zoe z@q.test"), (None, None), (5, prose(9000, 22)), (6, 'token = "a8f5f167f44f4964e6c998dee827110c" x'), (7, "é" * 700)]
    schema = "doc_id long, text string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, None, None, *["kept"] * len(CLASHING)) for i, t in texts], schema)


# ---------------------------------------------------------------- personal data


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    only = lambda x: re.sub("[^0-9]", "", x)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(only(m[0])) <= 15]


def brute_terms(texts):
    """Words that reveal an entity: straight from n(t), n(t, e), n(e) and n."""
    everywhere, near, around = Counter(w for t in texts for w in words(t)), Counter(), Counter()
    for t in filter(None, texts):
        spans = base_spans(t)
        found = [(m.start(), m.end(), m[0].translate(LOW)) for m in WORDS.finditer(t.translate(LOW))]
        free = [all(e <= s0 or s >= e0 for _, s0, e0 in spans) for s, e, _ in found]
        by_entity = defaultdict(set)
        for kind, s0, e0 in spans:
            left = [k for k, (s, e, _) in enumerate(found) if e <= s0][-pii.REACH :]
            right = [k for k, (s, e, _) in enumerate(found) if s >= e0][: pii.REACH]
            by_entity[kind, t[s0:e0].lower()].update(k for k in left + right if free[k])
        for entity, own in by_entity.items():
            for k in own:
                near[entity, found[k][2]] += 1
                around[entity] += 1
    total = sum(everywhere.values())
    return {w for (entity, w), n in near.items() if n / (everywhere[w] + pii.SMOOTH) >= pii.DISCLOSURE and math.log2(n * total / (everywhere[w] * around[entity])) >= pii.BITS}


def brute_pii(rows):
    terms = brute_terms([t for _, t in rows])
    out = []
    for i, t in rows:
        base = base_spans(t or "")
        extra = [m.span() for m in WORDS.finditer((t or "").translate(LOW)) if m[0] in terms]
        text = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        out.append((i, *[sum(x[0] == k for x in base) for k in range(4)], hashlib.sha256(",".join(text).encode()).hexdigest(), ",".join(text + [f"term:{s}:{e}" for s, e in extra])))
    return out, terms


def test_pii_whole_query(spark, documents):
    wanted, terms = brute_pii(sorted(documents.items()))
    assert sorted(tuple(r) for r in pii.op9_pii(spark, DATA).collect()) == wanted
    assert any(n for r in wanted for n in r[1:5])


def brute_sanitised(text, spans):
    """From the joined spans: the first of overlapping ones counts, the longest of those that start together."""
    found = sorted((int(s), -int(e), kind) for kind, s, e in (x.split(":") for x in spans.split(",") if x))
    parts, at = [], 0
    for s, e, kind in found:
        if s >= at:
            parts += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, -e)
    return "".join([*parts, text[at:]])


@pytest.mark.parametrize("block", [1, 2_000_000])
def test_pii_blocks_lose_no_row(spark, monkeypatch, block):
    monkeypatch.setattr(pii, "BLOCK", block)
    rows = [(1, "ask Lee or jsmith7 at zed@corp.test now"), (1, "ask Lee or jsmith7 at zed@corp.test now"), (None, "call +49 30 1234567 or 10.0.0.1 of Qux Ärger"), (None, "Qux"), (2, None), (3, ""), (4, prose(30_000, 99) + " ask or at now call of " * 9), (5, "4532015112830366 Lee 1.2.3.4 a@b.c x@y.z")]
    wanted, terms = brute_pii(rows)
    assert terms == {"jsmith7", "Ärger"}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.digests(pii.marked(docs, pii.written(pii.revealing(docs)))).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert sorted(r.text or "" for r in pii.sanitised(docs).collect()) == sorted(brute_sanitised(t or "", w[-1]) for (_, t), w in zip(rows, wanted))


# ---------------------------------------------------------------- contamination


def brute_hits(text, items, window=13):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        own = words(t)
        n = min(len(own), window)
        for p in range(len(own) - n + 1 if n else 0):
            for q in range(len(w) - n + 1):
                if w[q : q + n] == own[p : p + n]:
                    hit.update(range(q, q + n))
                    ids.add(i)
    return len(w), len(hit), ids


def test_longest_matches(spark):
    a, b = prose(40, 1).split(), prose(30, 2).split()
    docs = [(1, " ".join(["x", *a[3:30], "y", *b[:13], "z", *a[20:40]])), (None, None), (2, " ".join(b[:12]))]
    bench = [(7, " ".join(a)), (8, " ".join(b)), (9, None)]
    got = {(r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words) for r in decontaminate.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(1, "7", 1, 3, 27), (1, "8", 29, 0, 13), (1, "7", 43, 20, 20)}


# ---------------------------------------------------------------- fingerprints


def brute_print(text, k=winnow.K, w=winnow.W):
    raw = text.encode()
    gram = lambda a, b: int(V.Hasher(np.frombuffer(raw[a:b], np.uint8)).spans(np.array([0]), np.array([b - a]))[0]) >> 24
    if not raw:
        return ""
    if len(raw) < k:
        return f"0:{gram(0, len(raw)):010x}"
    # the gram hash is of its own kind, the same wherever the gram stands
    h = [int(x) >> 24 for x in V.Hasher(np.frombuffer(raw, np.uint8)).grams(k)]
    picked = set()
    for a in range(max(1, len(h) - w + 1)):
        own = h[a : a + w]
        picked.add(a + max(i for i, x in enumerate(own) if x == min(own)))
    return ",".join(f"{p}:{h[p]:010x}" for p in sorted(picked))


def test_fingerprints_whole_query(spark, documents):
    rows = {r.doc_id: r for r in winnow.op4_fingerprint(spark, DATA).collect()}
    order = sorted(documents, reverse=True)
    likeness = lambda x, y: 1.0 if not (x or y) else len(x & y) / len(x | y)
    hashes = lambda p: {x.split(":")[1] for x in p.split(",") if x}
    for i, after in zip(order[::4], [*order[1:], order[0]][::4]):
        t, nxt = documents[i] or "", documents[after] or ""
        if len(t) > 8000:
            continue
        cut = len(t) // 3
        own, edited, other = (brute_print(x) for x in (t, t[: len(t) - cut] + nxt[:cut], nxt))
        r = rows[i]
        assert (r.fingerprint, r.edited_fingerprint) == (own, edited)
        assert r.near_edited == pytest.approx(likeness(hashes(own), hashes(edited))) and r.near_next == pytest.approx(likeness(hashes(own), hashes(other)))


# ---------------------------------------------------------------- secrets


def brute_features(v, before, after, path):
    n = max(len(v), 1)
    share = lambda p: len(re.findall(p, v)) / n
    runs = re.sub("[^0Aa]+", "-", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "0", v))))
    has = lambda p, t: float(bool(re.search(p, t)))
    return {
        "length": float(len(v)), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "symbols": share("[^A-Za-z0-9]"), "changes": len(runs) / n,
        "distinct": len(set(v)) / min(n, 64), "hex": has("^[0-9a-f]+$", v.lower()), "letters_run": float(max(map(len, re.findall("[A-Za-z]+", v)), default=0)),
        "dictionary": (n - len(re.sub("|".join(secrets.DICTIONARY), "", v.lower()))) / n, "vowels": share("[AEIOUaeiou]"), "keyword": has(secrets.KEYWORDS, before.lower()),
        "harmless": has(secrets.HARMLESS, before.lower()), "placeholder": has(secrets.PLACEHOLDER, v.lower()), "quoted": has("[\"']$", before) * has("^[\"']", after), "assigned": has("[:=] ?[\"']?$", before),
        "dots": share("[.]"), "slashes": share("/"), "test_path": has("test|example|sample|doc", path.lower()), "dashes": share("[_-]"), "prefix": has(f"^({secrets.PREFIXES})", v),
    }


class Tree:
    """The compiled forest, read back: if(f.name <= x, then, else), sums and numbers."""

    def __init__(self, sql):
        self.code = compile(re.sub(r"if\(", "iff(", sql).replace("D", "").replace("iff(f.", "iff(f['").replace(" <= ", "'] <= "), "forest", "eval")

    def __call__(self, f):
        return eval(self.code, {"iff": lambda c, a, b: a if c else b, "f": f})  # noqa: S307


def brute_findings(text, path, tree):
    out = []
    for m in re.finditer(secrets.CANDIDATE, text or ""):
        lead = re.match(secrets.LEAD, m[0])
        at = m.start() + (len(lead[0]) if lead else 0)
        # what stands before a value reaches back to the last match, what follows it to the next
        before, after = text[:at], text[m.end() :]
        last = [x.end() for x in re.finditer(secrets.CANDIDATE, text) if x.end() <= m.start()]
        before = text[last[-1] if last else 0 : at][-secrets.NEAR :]
        following = re.search(secrets.CANDIDATE, after)
        after = after[: following.start() if following else None][: secrets.NEAR]
        out.append((at, m.end() - at, tree(brute_features(text[at : m.end()], before, after, path or ""))))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return secrets.forest(secrets.generated_findings(spark))


def test_secrets_whole_query(spark, documents, model):
    tree = Tree(model)
    sources = dict(duckdb.connect().execute(f"SELECT doc_id, source FROM '{DATA}/documents.parquet'").fetchall())
    got = defaultdict(list)
    for r in secrets.op6_secrets(spark, DATA).collect():
        got[r.doc_id].append((r.start, r.length, r.score))
        assert r.is_secret == (r.score >= secrets.THRESHOLD)
    n = 0
    for i, t in documents.items():
        wanted = brute_findings(t, sources[i], tree)
        assert [x[:2] for x in sorted(got[i])] == [x[:2] for x in wanted]
        assert [x[2] for x in sorted(got[i])] == pytest.approx([x[2] for x in wanted])
        n += len(wanted)
    assert n


# ---------------------------------------------------------------- classifiers


def brute_statistics(text):
    raw = (text or "").encode()
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = re.findall(rb"[^\n\r]+", raw)
    low = Counter(t.lower() for t in tokens)  # bytes.lower changes A-Z only
    share = lambda n, of: math.asin(math.sqrt(min(max(n / max(of, 1), 0), 1)))
    many = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    long, n, w = sum(min(len(t), 40) for t in tokens), len(raw), len(tokens)
    return [
        math.log1p(n), math.log1p(long / max(w, 1)), share(many(range(65, 91)), n), share(many(b"0123456789"), n), share(many(b".,;:!?'\"()-"), n), share(many(b"#$%&*+/<=>@[\\]^_`{|}~"), n),
        share(n - long, n), math.log1p(len(lines) / max(w, 1) * 10), share(sum(len(x) < 40 for x in lines), len(lines)), share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(len(low) / math.sqrt(max(w, 1))), share(w - len(low), w), share(many(b".!?"), w), share(many(b"|"), w), share(max(low.values(), default=0), w),
    ]


def test_quality_whole_query(spark, documents):
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall())
    ids = sorted(documents)
    x = np.array([brute_statistics(documents[i]) for i in ids])
    assert np.allclose(quality.statistics(pa.array([documents[i] for i in ids])), x)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}
    y = np.array([labels[i] if i in labels and not held[i] else -1 for i in ids])
    own = {c: x[y == c] for c in (0, 1)}
    total = sum(map(len, own.values()))
    within = {c: np.cov(v.T, bias=True) for c, v in own.items()}
    pooled = sum(len(own[c]) * within[c] for c in own) / total + 1e-6 * np.eye(x.shape[1])
    density = {}
    for c, v in own.items():
        s = (1 - quality.POOLED - quality.DIAGONAL) * within[c] + quality.POOLED * pooled + quality.DIAGONAL * np.diag(np.diag(pooled))
        d = x - v.mean(0)
        density[c] = math.log(len(v) / total) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (d * np.linalg.solve(s, d.T).T).sum(1)
    wanted = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
    rows = {r.doc_id: r for r in quality.op7_quality(spark, DATA).collect()}
    assert np.allclose([rows[i].score for i in ids], wanted, atol=1e-6)
    assert all(rows[i].held_out == held[i] and rows[i].predicted == int(rows[i].score >= 0.3) for i in ids)


def brute_grams(text):
    w = words(text)
    return {(kind, *(w[i + s] for s in steps)) for kind, steps in enumerate(toxicity.GRAMS) for i in range(len(w) - steps[-1])}


def test_toxicity_by_the_book(spark):
    """FTRL-proximal with a dictionary of features, on texts of so few that no two share a hash."""
    texts = [(k, f"{'vile nasty' if k % 3 == 0 else 'kind warm'} {prose(6, k)}") for k in range(40)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(40)], "doc_id long, toxic int")
    train = [r.doc_id for r in docs.join(labels.filter(toxicity.fold_of() != 0), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    text, z, n = dict(texts), defaultdict(float), defaultdict(float)

    def weight(f):
        l1 = 0 if f == "bias" else toxicity.L1
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    def score(t):
        return 1 / (1 + math.exp(-sum(weight(f) for f in (*brute_grams(t), "bias"))))

    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(toxicity.EPOCHS):
        for r in rng.permutation(len(train)):
            t, y = text[train[r]], int(train[r] % 3 == 0)
            for _ in range(toxicity.POSITIVE if y else 1):
                g, w = score(t) - y, {f: weight(f) for f in (*brute_grams(t), "bias")}
                for f, old in w.items():
                    z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * old
                    n[f] += g * g
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert got == pytest.approx({i: score(t) for i, t in texts})
    assert len(set(got.values())) > 2


# ---------------------------------------------------------------- packing


def test_pieces_whole_query(spark, documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(pack.default_path())
    wanted = set()
    for i, t in documents.items():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [len(ids)]
        while cuts[-1] > 2048:
            cuts.append(cuts[-1] - 2048)
        cuts = [0, *cuts[::-1]]
        wanted |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    rows = pack.op8_pack(spark, DATA).collect()
    assert len(rows) == len(wanted) and {tuple(r)[:5] for r in rows} == wanted


def test_salts_follow_counts(spark, monkeypatch):
    assert [pack.salts_of(n) for n in (1, 1000, 1001, 10**6, 10**8)] == [1, 1, 2, 64, 400]
    monkeypatch.setattr(pack, "salts_of", lambda n: max(1, n // 7))
    items = spark.createDataFrame([(k, 0, 4 if k % 3 else 6) for k in range(300)], "doc_id long, piece int, length long")
    rows = pack.pack(items, 10).collect()
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 300 and all(sum(n for _, n in x) <= 10 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in at.values())
    assert len(at) == 150


# ---------------------------------------------------------------- language model


def brute_forward(w, symbols, start, per):
    """Natural log-likelihood of one document, token by token, in double precision."""
    k = w["u"].shape[0]
    h, before, out = np.zeros(k), start, 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda a: np.exp(a - a.max()) / np.exp(a - a.max()).sum()
    for y in symbols:
        gx, gh = w["emb"][before] @ w["wx"] + w["b"], h @ w["u"]
        z, r = sigmoid(gx[:k] + gh[:k]), sigmoid(gx[k : 2 * k] + gh[k : 2 * k])
        n = np.tanh(gx[2 * k :] + r * gh[2 * k :])
        h = (1 - z) * n + z * h
        out += math.log(softmax(h @ w["wc"] + w["bc"])[y // per]) + math.log(softmax(h @ w["ww"][y // per] + w["bw"][y // per])[y % per])
        before = y
    return out


def network():
    p = np.sort(np.random.default_rng(3).random(100))[::-1]
    return language_model.Network(p / p.sum())


def test_scores_are_of_the_plain_forward_pass():
    net, rng = network(), np.random.default_rng(5)
    docs = [rng.integers(0, 100, n).astype(np.int32) for n in (1, 40, 3, 700, 12)]
    first = np.r_[0, np.cumsum([len(d) for d in docs])]
    w = {k: v.astype(float) for k, v in net.w.items()}
    wanted = [brute_forward(w, d, 7, net.per) for d in docs]
    for lanes in (1, 2, 512):
        assert np.allclose(net.score(np.concatenate(docs), first, 7, lanes), wanted, rtol=1e-4)
    assert net.bounded()
    net.w["wc"] *= 1000
    assert not net.bounded()
    w = {k: v.astype(float) for k, v in net.w.items()}
    assert np.allclose(net.score(np.concatenate(docs), first, 7), [brute_forward(w, d, 7, net.per) for d in docs], rtol=1e-3)


def test_gradient_against_differences():
    """The first step of Adam keeps a tenth of the gradient of the mean negative log-likelihood."""
    net, rng = network(), np.random.default_rng(6)
    lanes = rng.integers(0, 100, (3, 10)).astype(np.int32)
    fresh = np.zeros(lanes.shape, bool)
    fresh[:, 0] = fresh[1, 4] = True
    docs = [lanes[0], lanes[1, :4], lanes[1, 4:], lanes[2]]
    w = {k: v.astype(float) for k, v in net.w.items()}
    loss = lambda: -sum(brute_forward(w, d, 7, net.per) for d in docs) / lanes.size
    adam: dict = {}
    net.train(lanes, fresh, 7, epochs=1, steps=10, adam=adam)
    for key in w:
        flat = w[key].reshape(-1)
        for at in rng.choice(flat.size, 4, replace=False).tolist() + [int(np.abs(adam["m"][key]).argmax())]:
            kept, sides = flat[at], []
            for step in (1e-4, -1e-4):
                flat[at] = kept + step
                sides.append(loss())
            flat[at] = kept
            assert adam["m"][key].reshape(-1)[at] * 10 == pytest.approx((sides[0] - sides[1]) / 2e-4, rel=2e-3, abs=2e-6)


# ---------------------------------------------------------------- pipeline


def test_later_stages(spark, documents, model):
    """Contamination, secrets and packing, each on the whole of documents."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = duckdb.connect().execute(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    stage = dict(corpus_pipeline.STAGES)
    short = {i: t for i, t in documents.items() if len(t or "") < 3000}
    hits = {i: brute_hits(t, bench) for i, t in short.items()}
    clean = {i for i, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}
    kept = {r.doc_id for r in stage["decontamination"](spark, docs, DATA).select("doc_id").collect()}
    assert kept & set(short) == clean
    tree = Tree(model)
    for r in stage["secrets"](spark, docs, DATA).collect():
        t, parts, at = documents[r.doc_id] or "", [], 0
        for start, length, score in brute_findings(t, r.source, tree):
            if score >= secrets.THRESHOLD:
                parts += [t[at:start], secrets.MASK]
                at = start + length
        wanted = "".join([*parts, t[at:]])
        assert (r.text or "") == wanted and (not parts or r.n_chars == len(wanted))
    packed = stage["packing"](spark, docs, DATA)
    assert sorted(tuple(r) for r in packed.drop("sequence_id", "offset").collect()) == sorted(tuple(r)[:5] for r in pack.op8_pack(spark, DATA).collect())


def test_pipeline_leaves_no_tables(spark):
    from quaver.llm import _common

    before = list(_common.made)
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() and len(_common.made) == len(before) + 1


# ---------------------------------------------------------------- edges


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_filters_keep_clashing_columns(spark, clashing, model):
    bench = spark.createDataFrame([(1, prose(20, 77)), (1, None)], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for block in (1, 10**6):
        assert rows_of(decontaminate.decontaminate(clashing, bench, block_bytes=block)) == rows_of(clashing)
        assert decontaminate.judged(decontaminate.contamination(clashing, bench, block_bytes=block)).count() == clashing.count()
    kept = jaccard.representatives(clashing)
    assert kept.columns == clashing.columns and kept.count() == 5 and {r._key for r in kept.collect()} == {"kept"}
    masked = secrets.redacted(clashing, model)
    assert masked.columns == clashing.columns and [r.text for r in masked.filter("doc_id = 6").collect()] == ['token = "[SECRET]" x']
    assert rows_of(masked.filter("doc_id <> 6 OR doc_id IS NULL")) == rows_of(clashing.filter("doc_id <> 6 OR doc_id IS NULL"))
    assert quality.kept(clashing, none).columns == clashing.columns
    clean = pii.sanitised(clashing)
    assert clean.columns == clashing.columns and clean.count() == clashing.count() and {r.base for r in clean.collect()} == {"kept"}
    assert any("[EMAIL]" in (r.text or "") for r in clean.collect())


def test_rows_for_every_document(spark, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    n = clashing.count()
    assert quality.quality_scores(clashing, none).count() == n == toxicity.toxicity(clashing, none).count()
    assert pii.digests(pii.marked(clashing, pii.revealing(clashing))).count() == n
    scores = language_model.lm_scores(clashing).collect()
    assert len(scores) == n and all(r.score < 0 and r.n_known <= r.n_tokens for r in scores)
    assert len({round(r.score, 6) for r in scores if r.doc_id in (3, 4)}) == 1
    packed = pack.packed(clashing).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in clashing.collect())


def test_empty_tables(spark, clashing, model):
    docs = clashing.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        quality.quality_scores(docs, none), quality.kept(docs, none), toxicity.toxicity(docs, none), decontaminate.judged(decontaminate.contamination(docs, bench)), decontaminate.decontaminate(docs, bench),
        secrets.findings(docs, model), secrets.redacted(docs, model), pack.packed(docs), pii.digests(pii.marked(docs, pii.revealing(docs))), pii.sanitised(docs), language_model.lm_scores(docs), jaccard.representatives(docs),
    ):
        assert out.count() == 0
    assert decontaminate.decontaminate(clashing, bench).count() == clashing.count()


def test_very_long_texts(spark, model):
    """A text of some megabytes goes through every operator but the recurrent one, whose state takes a step for each token."""
    long = prose(300_000, 60)
    docs = spark.createDataFrame([(1, long, "s", len(long)), (2, long + " end", "s", 0)], "doc_id long, text string, source string, n_chars long")
    assert {r.n_links for r in jaccard.classes(docs).collect()} == {1}
    assert all(r.n_removed > 0.99 * r.n_bytes for r in substrings.deduplicated(docs).collect())
    assert all(r.near_next > 0.99 for r in winnow.edited_fingerprints(docs).collect())
    assert secrets.redacted(docs, model).count() == 2 and pii.sanitised(docs).count() == 2
    bench = spark.createDataFrame([(1, " ".join(long.split()[1000:1020]))], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.judged(decontaminate.contamination(docs, bench)).collect()] == [20, 20]
    packed = pack.packed(docs).collect()
    assert sum(r.length for r in packed) == 2 * sum(len(x) for x in pack.encoder(pack.default_path()).texts(pa.array([long]))) + 2 + len(next(pack.encoder(pack.default_path()).texts(pa.array([" end"]))))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.kept(docs, none).count() == 2 == toxicity.toxicity(docs, none).count()
