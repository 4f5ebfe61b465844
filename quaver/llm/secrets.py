"""Secret scans: a random forest removes false positives from pattern findings.

Everything runs as DataFrame expressions.  One pattern finds candidates (quoted
values after ``=`` or ``:``, and long tokens), the same pattern splits the text
into what lies between them, so that each candidate has its place and its
neighbouring words.  Features are length, character shares and transitions,
dictionary coverage, neighbouring words and the path.  The forest is trained on
labelled findings and compiled into one SQL expression over those features,
evaluated inside the arrays: no row leaves its document and nothing is shuffled.

Labelled findings are a DataFrame (before, value, after, path, label).  No
table of them is supplied, so :func:`generated_findings` derives ``FINDINGS``
rows from a seed: keys and tokens of common shapes in assignments against
hashes, identifiers, file names, hosts, dates and placeholders; and, without any
digit, random letters and passphrases against prose, names and references.

Defined cases: a null or empty text has no findings and is left as it is; a
null path counts as empty; a very long text is scanned whole within its row;
repeated rows give their findings each; repeated values in one text are
separate findings; an empty table gives an empty result; extra columns,
whatever their names, are kept by :func:`redacted` and ignored by
:func:`findings`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free, table

FINDINGS, TREES, DEPTH, SEED = 4000, 15, 6, 17
THRESHOLD = 0.5
MASK = "[SECRET]"
_CHAR = r"A-Za-z0-9+/_.\-"
_NAMED = r"(?i:passw(?:or)?d|pwd|secret|token|api.?key)\s?[:=]\s?[\"']?"
#: Key blocks; assignments to telling names; quoted values; long tokens. No alternative looks far behind itself.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|{_NAMED}[^\s\"']{{6,}}+"
    r"|[:=]\s?[\"'][^\s\"']{8,}+(?=[\"'])"
    rf"|(?<![{_CHAR}])[{_CHAR}]{{16,}}+={{0,2}}"
)
#: What a match has before its value.
LEAD = rf"^(?:{_NAMED}|[:=]\s?[\"'])"
#: Openings of tokens that their issuers document.
PREFIXES = "AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-|AIza|npm_|-----BEGIN"
#: Characters of text kept on each side of a candidate.
NEAR = 40
KEYWORDS = "token|secret|api.?key|apikey|access.?key|passw|pwd|auth|bearer|credential|private|signature"
HARMLESS = "commit|sha1|sha256|md5|checksum|digest|hash|uuid|revision|etag|version|file|path|url|href|src"
PLACEHOLDER = "example|sample|dummy|changeme|placeholder|your|insert|xxxx|test|todo|fake"
DICTIONARY = ("access account address admin alpha application archive backup base beta build button cache class client cloud code common config connect content "
              "control core data database default delta design device document domain download driver email engine error event export file filter final first "
              "folder format function global group handler header help host html image import index info input internal item java json kernel label language "
              "layer left library list local login mail main manager master menu message method model module monitor name network node object online option "
              "order output package page panel parser password path payment plugin policy port print process product profile project provider public python "
              "query queue read record release report request resource response result root route sample schema script search secret section server service "
              "session setting setup simple site size source start state static status storage store stream string style support system table target task "
              "template test text theme time title token tool type update upload user util value version video view window worker").split()  # fmt: skip
FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "changes", "distinct", "hex", "letters_run", "dictionary", "vowels", "keyword", "harmless", "placeholder", "quoted", "assigned", "dots", "slashes", "test_path", "dashes", "prefix")


def _feature_sql(v: str, before: str, after: str, path: str) -> dict[str, str]:
    """Each feature as SQL over a candidate value, the text before and after it, and the document's path."""
    n = f"greatest(length({v}), 1)"
    left = lambda p: f"length(regexp_replace({v}, '{p}', ''))"
    words = "|".join(DICTIONARY)
    return {
        "length": f"cast(length({v}) as double)",
        "digits": f"{left('[^0-9]')} / {n}",
        "uppers": f"{left('[^A-Z]')} / {n}",
        "lowers": f"{left('[^a-z]')} / {n}",
        "symbols": f"{left('[A-Za-z0-9]')} / {n}",
        "changes": f"length(regexp_replace(regexp_replace(regexp_replace(regexp_replace({v}, '[0-9]+', '0'), '[A-Z]+', 'A'), '[a-z]+', 'a'), '[^0Aa]+', '-')) / {n}",
        "distinct": f"size(array_distinct(split({v}, ''))) / least({n}, 64)",
        "hex": f"if(lower({v}) rlike '^[0-9a-f]+$', 1.0D, 0.0D)",
        "letters_run": f"cast(coalesce(array_max(transform(regexp_extract_all({v}, '([A-Za-z]+)', 1), x -> length(x))), 0) as double)",
        "dictionary": f"({n} - length(regexp_replace(lower({v}), '{words}', ''))) / {n}",
        "vowels": f"{left('[^AEIOUaeiou]')} / {n}",
        "keyword": f"if(lower({before}) rlike '{KEYWORDS}', 1.0D, 0.0D)",
        "harmless": f"if(lower({before}) rlike '{HARMLESS}', 1.0D, 0.0D)",
        "placeholder": f"if(lower({v}) rlike '{PLACEHOLDER}', 1.0D, 0.0D)",
        "quoted": f"if({before} rlike '[\"\\']$' and {after} rlike '^[\"\\']', 1.0D, 0.0D)",
        "assigned": f"if({before} rlike '[:=] ?[\"\\']?$', 1.0D, 0.0D)",
        "dots": f"{left('[^.]')} / {n}",
        "slashes": f"{left('[^/]')} / {n}",
        "test_path": f"if(lower({path}) rlike 'test|example|sample|doc', 1.0D, 0.0D)",
        "dashes": f"{left('[^_-]')} / {n}",
        "prefix": f"if({v} rlike '^({PREFIXES})', 1.0D, 0.0D)",
    }


def generated_findings(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """Labelled findings derived from a seed: before, value, after, path, label."""
    rows = spark.range(0, n, 1, 4).withColumn("r", F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256))
    pick = lambda items, salt: F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(F.xxhash64("r", F.lit(salt)), F.lit(len(items))) + 1).cast("int"))
    word = lambda salt: pick(DICTIONARY, salt)
    hexes = lambda salt, k: F.substring(F.sha2(F.concat("r", F.lit(salt)), 512), 1, k)
    b64 = lambda salt, k: F.substring(F.base64(F.unhex(F.sha2(F.concat("r", F.lit(salt)), 512))), 1, k)
    number = lambda salt, k: F.pmod(F.xxhash64("r", F.lit(salt)), F.lit(k)).cast("string")
    real = F.element_at(
        F.array(
            hexes("a", 32), hexes("a2", 18), hexes("b", 40), F.upper(hexes("c", 40)), hexes("d", 64), b64("e", 32), b64("f", 40), b64("g", 64),
            F.concat(pick(("pk", "sk", "key", "tok"), 1), F.lit("_"), F.regexp_replace(b64("h", 36), "[+/=]", "")), F.concat(F.lit("AK"), F.upper(F.regexp_replace(b64("i", 18), "[+/=]", "7"))),
        ),
        (F.pmod(F.xxhash64("r", F.lit("kind")), F.lit(10)) + 1).cast("int"),
    )
    harmless = F.element_at(
        F.array(
            F.concat_ws("_", word(2), word(3), word(4), number(5, 100)),
            F.concat(word(6), F.lit("-"), word(7), F.lit("."), number(8, 20), F.lit("."), number(9, 20), F.lit(".tar.gz")),
            F.concat(word(10), number(11, 10), F.lit(".example.com")),
            F.concat(word(12), F.lit("/"), word(13), F.lit("/"), word(14), number(15, 1000), F.lit(".json")),
            F.concat_ws("-", hexes("j", 8), hexes("k", 4), hexes("l", 4), hexes("m", 4), hexes("n", 12)),
            F.concat(F.lit("20"), F.lpad(number(16, 30), 2, "0"), F.lit("-0"), number(17, 9), F.lit("-1"), number(18, 9), F.lit("T0"), number(19, 9), F.lit("-30-00")),
            F.concat(pick(("your", "example", "changeme", "placeholder", "xxxxxxxx", "dummy"), 20), F.lit("_"), word(21), F.lit("_key_"), number(22, 10)),
            F.concat(F.initcap(word(23)), F.initcap(word(24)), F.initcap(word(25)), number(26, 10)),
            F.concat(word(27), F.lit("."), word(28), F.lit("."), word(29), number(30, 99)),
        ),
        (F.pmod(F.xxhash64("r", F.lit("other")), F.lit(9)) + 1).cast("int"),
    )
    letters = lambda salt, k: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat("r", F.lit(salt)), 512))), "[+/=]", ""), 1, k)
    known = F.concat(pick(("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "AIza", "npm_"), 40), F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, F.upper(letters("s", 16))).otherwise(letters("t", 34)))
    hashes = F.element_at(F.array(hexes("o", 32), hexes("p", 40), hexes("q", 64)), (F.pmod(F.xxhash64("r", F.lit("size")), F.lit(3)) + 1).cast("int"))
    # values without a digit: random letters and passphrases in quotes; prose, names, paths and references
    only = lambda salt, k: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat("r", F.lit(salt)), 512))), "[0-9+/=]", ""), 1, k)
    other = lambda salt: F.lower(only(salt, 6))
    bare = F.element_at(
        F.array(only("u", 20), only("v", 32), only("w", 40), F.concat_ws("-", word(50), other("x"), word(51)), F.concat_ws("-", other("y"), other("z"), word(52), other("aa"))),
        (F.pmod(F.xxhash64("r", F.lit("bare")), F.lit(5)) + 1).cast("int"),
    )
    prose = F.element_at(
        F.array(
            word(53), F.concat(word(54), word(55)), F.concat(word(56), word(57), word(58)), F.concat_ws("_", word(59), word(60), word(61)), F.concat(word(62), F.initcap(word(63)), F.initcap(word(64))),
            F.concat_ws(".", word(65), word(66), word(67)), F.concat_ws("/", word(68), word(69), word(70)), F.concat_ws("-", word(71), word(72), word(73)), F.concat(word(74), F.lit(","), word(75)), F.concat(F.lit("${"), F.upper(word(76)), F.lit("_KEY}")),
            F.concat(F.lit("get_"), word(77), F.lit("("), word(78), F.lit(")")), F.concat(F.lit("your-"), word(79), F.lit("-"), word(80)), F.regexp_replace(F.lit("------------------------"), "-", pick(("-", "_", ".", "/"), 81)),
            F.concat(F.substring(word(88), 2, 5), F.substring(word(89), 1, 4)), F.concat(F.substring(word(90), 2, 3), F.substring(word(91), 1, 4), F.substring(word(92), 3, 4)),
            *(F.concat(F.upper(F.concat(F.substring(word(k), 2, 5), F.substring(word(k + 1), 2, 5), word(k + 2), F.substring(word(k + 3), 1, 4))), F.lit(end)) for k, end in ((100, ""), (104, "."), (108, ""), (112, ""))),
            F.concat(F.initcap(F.concat(F.substring(word(120), 2, 5), word(121), F.substring(word(122), 2, 5))), F.lit("."), F.initcap(word(123))), F.concat(F.initcap(F.concat(F.substring(word(124), 2, 5), word(125))), F.lit("-"), F.initcap(word(126))),
        ),
        (F.pmod(F.xxhash64("r", F.lit("prose")), F.lit(21)) + 1).cast("int"),
    )
    case = F.pmod(F.xxhash64("r", F.lit("case")), F.lit(26))
    secret_before = F.concat(word(31), F.lit(" "), pick(("token", "secret", "api_key", "apiKey", "access_key", "password", "auth_token", "TOKEN", "SECRET_KEY", "bearer", "credential", "private_key"), 32), pick((' = "', '="', ": '", '": "', " = ", "="), 33))
    hash_before = F.concat(word(34), F.lit(" "), pick(("commit", "sha256", "md5", "checksum", "digest", "etag", "revision", "uuid", "hash of the file"), 35), pick((' = "', ": ", " ", '="'), 36))
    quoted_before = F.concat(word(82), F.lit(" "), pick(("token", "secret", "api_key", "password", "access_key", "credential"), 83), pick((' = "', '="', ': "'), 84))
    loose_before = F.concat(word(85), F.lit(" "), pick(("token", "secret", "password", "api key"), 86), pick((": ", " = ", "="), 87))
    plain_before = F.concat(word(37), F.lit(" "), word(38), pick((" ", ' = "', ": ", "\n", '("'), 39))
    made = rows.select(
        F.when(case < 7, secret_before).when(case < 9, F.when(F.pmod(F.xxhash64("r"), F.lit(3)) == 0, secret_before).otherwise(plain_before)).when(case < 13, hash_before).when(case < 14, secret_before).when(case < 20, plain_before).when(case < 22, quoted_before).when(case < 24, loose_before).otherwise(plain_before).alias("before"),
        F.when(case < 7, real).when(case < 9, known).when(case < 13, hashes).when(case < 20, harmless).when(case < 22, bare).otherwise(prose).alias("value"),
        ((case < 9) | case.isin(20, 21)).cast("double").alias("label"),
        F.when(case % 4 == 0, F.lit("tests/data")).otherwise(F.lit("src")).alias("path"),
    )
    return made.withColumn("after", F.when(F.col("before").rlike("[\"']$"), F.lit('" ')).otherwise(F.lit(" ")))


def forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> str:
    """The share of trees that call a finding a secret, as SQL over fields of a struct ``f``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    x = labelled.select("label", *[F.expr(s).alias(k) for k, s in _feature_sql("value", "before", "after", "coalesce(path, '')").items()])
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(x).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data)
    return "(" + " + ".join(f"({_tree_sql(t.toDebugString)})" for t in model.trees) + f") / {float(trees)}D"


def _tree_sql(text: str) -> str:
    """A printed tree as nested conditionals."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", line):
            return f"{float(m[1])}D"
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        if not m:
            raise ValueError(f"unknown node: {line}")
        low = node()
        if not lines[at].startswith("Else"):
            raise ValueError(f"unknown node: {lines[at]}")
        at += 1
        return f"if(f.{FEATURES[int(m[1])]} <= {float(m[2])!r}D, {low}, {node()})"

    return node()


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _once(df: DataFrame, name: str, sql: str) -> DataFrame:
    """Adds a column behind a generator, so that later uses never evaluate its expression again."""
    made = free("_made", df.columns)
    return df.select("*", F.explode(F.array(F.struct(F.expr(sql).alias("v")))).alias(made)).select(*df.columns, F.col(f"{made}.v").alias(name))


def scanned(docs: DataFrame, model: str, path: str | None = "source") -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: the text between matches, and an array of (lead, value, start, score) structs."""
    matches, between, places, seen, found = (free(c, docs.columns) for c in ("_matches", "_between", "_places", "_seen", "_found"))
    source = f"coalesce(cast(`{path}` as string), '')" if path and path in docs.columns else "''"
    pattern = _quoted(CANDIDATE)
    out = _once(docs, matches, f"regexp_extract_all(coalesce(text, ''), {pattern}, 0)")
    out = _once(out, between, f"if(size({matches}) = 0, array(coalesce(text, '')), split(coalesce(text, ''), {pattern}, -1))")
    # where each match begins: sums of all lengths before it, by doubling, so that n matches cost n log n
    sizes = f"transform({between}, (t, i) -> cast(length(t) + if(i = 0, 0, length({matches}[i - 1])) as bigint))"
    out = _once(out, places, f"if(size({matches}) = 0, null, aggregate(sequence(0, cast(ceil(log2(size({matches}))) as int)), {sizes}, (a, k) -> transform(a, (x, i) -> x + coalesce(get(a, i - shiftleft(1, k)), 0L))))")
    features = ", ".join(f"'{k}', {s}" for k, s in _feature_sql("c.value", "c.before", "c.after", source).items())
    led = f"transform({matches}, m -> named_struct('m', m, 'lead', regexp_extract(m, {_quoted(LEAD)}, 0)))"
    placed = (
        f"transform({led}, (x, i) -> named_struct('lead', x.lead, 'value', substr(x.m, length(x.lead) + 1), 'before', right(concat({between}[i], x.lead), {NEAR}), 'after', left({between}[i + 1], {NEAR}), "
        f"'start', length(x.lead) + {places}[i]))"
    )
    described = f"transform({placed}, c -> named_struct('c', c, 'f', named_struct({features})))"
    out = _once(out, seen, f"if(size({matches}) = 0, null, {described})")
    score = f"transform({seen}, s -> named_struct('lead', s.c.lead, 'value', s.c.value, 'start', s.c.start, 'score', element_at(transform(array(s.f), f -> {model}), 1)))"
    out = _once(out, found, score)
    return out.drop(matches, places, seen), between, found


def findings(docs: DataFrame, model: str, path: str | None = "source") -> DataFrame:
    """One row per candidate, rejected ones too: doc_id, start and length (code points), the digest of its value, score, is_secret."""
    wanted = ["doc_id", "text"] + [path] * bool(path and path in docs.columns)
    rows, _, found = scanned(docs.select(*wanted), model, path)
    rows = rows.select("doc_id", F.explode(found).alias("x"))
    return rows.select(
        "doc_id", F.col("x.start").alias("start"), F.length("x.value").cast("long").alias("length"), F.sha2("x.value", 256).alias("value_sha256"), F.col("x.score").alias("score"), (F.col("x.score") >= THRESHOLD).alias("is_secret")
    )


def redacted(docs: DataFrame, model: str, path: str | None = "source") -> DataFrame:
    """``docs`` with every secret replaced by a mask; ``n_chars``, where present, follows the text."""
    rows, between, found = scanned(docs, model, path)
    masked = F.expr(f"array_join(flatten(array(array({between}[0]), transform({found}, (x, i) -> concat(x.lead, if(x.score >= {THRESHOLD}, '{MASK}', x.value), {between}[i + 1])))), '')")
    changed = F.exists(found, lambda x: x["score"] >= THRESHOLD)
    out = rows.withColumn("text", F.when(changed, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"), forest(generated_findings(spark)))
