"""Rows of stored tables: upsert by key, children replaced, SQL dump (S-3, S-15, S-16, S-18); :mod:`versioned` stores them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_literal

TEXT = "TEXT"
#: SQL types of a dump by Spark's; anything else is text.
TYPES = {"int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    """S-3."""
    p, files = _files(spark, path)
    return files.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    p, files = _files(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(p)) if files.exists(p) else []


def latest(incoming: DataFrame, by: tuple[str, ...], version: str) -> DataFrame:
    """Of several rows of a key the latest version, of equal versions the one that is last as JSON."""
    row = F.struct(*[c for c in incoming.columns if c not in by])
    return incoming.groupBy(*by).agg(F.max_by(row, F.struct(F.col(version), F.to_json(row))).alias("r")).select(*by, "r.*")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """S-15: incoming rows replace existing ones of their key; of several incoming rows the latest version stays, of equal versions the one that is last as JSON."""
    new = latest(incoming, (key,), version)
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str, key: tuple[str, ...], ordinal: str) -> DataFrame:
    """S-16: all children of incoming parents go; of incoming ones with equal keys the first stays."""
    rest = [c for c in incoming.columns if c not in key]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*rest), ordinal).alias("r")).select(*key, "r.*").drop(ordinal)
    return existing.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(first)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def inserts(df: DataFrame, name: str) -> DataFrame:
    """An INSERT statement for each row; numbers bare, nulls as NULL, the rest quoted."""
    values = [F.coalesce(F.col(c).cast("int").cast("string") if t == "boolean" else F.col(c).cast("string") if t in TYPES else sql_literal(F.col(c).cast("string")), F.lit("NULL")) for c, t in df.dtypes]
    head = f"INSERT INTO {quoted(name)} ({', '.join(map(quoted, df.columns))}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *values), F.lit(");")).alias("statement"))


@dataclass(frozen=True)
class Reference:
    """Columns of a table that name a row of another by its key; a null names none."""

    columns: tuple[str, ...]
    table: str
    key: tuple[str, ...]


def dependent_order(tables: list[str], references: dict[str, tuple[Reference, ...]]) -> list[str]:
    """Tables after those that they refer to, otherwise as given; a table may refer to itself."""
    left, out = list(tables), []
    while left:
        free = [t for t in left if all(r.table in out or r.table == t for r in references.get(t, ()))]
        if not free:
            raise ValueError(f"references go round or out of the dump: {', '.join(left)}")
        out.append(free[0])
        left.remove(free[0])
    return out


def broken(tables: dict[str, DataFrame], keys: dict[str, tuple[tuple[str, ...], ...]], references: dict[str, tuple[Reference, ...]]) -> DataFrame:
    """(table, problem, columns, value, n): null or repeated keys, and references to no row; values as JSON."""
    spark, out = next(iter(tables.values())).sparkSession, None

    def add(table: str, problem: str, columns: tuple[str, ...], rows: DataFrame) -> None:
        nonlocal out
        found = rows.select(F.lit(table).alias("table"), F.lit(problem).alias("problem"), F.lit(", ".join(columns)).alias("columns"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"), "n")
        out = found if out is None else out.unionByName(found)

    for t, own in keys.items():
        for columns in own:
            groups = tables[t].groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
            whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in columns])
            add(t, "null in key", columns, groups.filter(~whole))
            add(t, "repeated key", columns, groups.filter(whole & (F.col("n") > 1)))
    for t, own in references.items():
        for r in own:
            named = tables[t].groupBy(*r.columns).agg(F.count(F.lit(1)).alias("n"))
            parents = tables[r.table].select(*(F.col(k).alias(f"_parent_{i}") for i, k in enumerate(r.key))).distinct()
            same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_parent_{i}") for i, c in enumerate(r.columns)])
            add(t, f"no such row of {r.table}", r.columns, named.dropna(how="any", subset=list(r.columns)).join(parents, same, "left_anti"))
    return out if out is not None else spark.createDataFrame([], "table string, problem string, columns string, value string, n long")


def dump(
    tables: dict[str, DataFrame],
    indexes: dict[str, tuple[str, tuple[str, ...]]] | None = None,
    metadata: str | None = None,
    required: tuple[str, ...] = (),
    keys: dict[str, tuple[tuple[str, ...], ...]] | None = None,
    references: dict[str, tuple[Reference, ...]] | None = None,
) -> DataFrame:
    """S-18: (step, statement): tables are dropped, created, filled, and indexed by name of the index; those that others refer to come first, and go last.

    indexes: name to (table, columns).  With ``metadata``, the name of a table of key and value, keys that it lacks raise
    before anything is made.  ``keys`` (the first one is the primary key) and ``references`` become constraints of the
    tables; rows that break them raise.
    """
    keys, references = keys or {}, references or {}
    tables = {t: tables[t] for t in dependent_order(list(tables), references)}
    if metadata is not None:
        have = {r[0] for r in tables[metadata].filter(F.col("key").isin(*required)).select("key").collect()}  # at most the required keys
        if lacking := sorted(set(required) - have):
            raise ValueError(f"metadata lacks {', '.join(lacking)}")
    for own in references.values():
        for r in own:
            if r.key not in keys.get(r.table, ()):
                raise ValueError(f"{', '.join(r.key)} is no key of {r.table}")
    if keys or references:
        found = broken(tables, keys, references).orderBy("table", "problem", "columns", "value").limit(20).collect()  # enough to tell
        if found:
            raise ValueError("; ".join(f"{r.table}: {r.problem} {r.value} ({r.n} rows)" for r in found))
    spark = next(iter(tables.values())).sparkSession
    names = lambda columns: ", ".join(map(quoted, columns))
    lines = [f"DROP TABLE IF EXISTS {quoted(t)};" for t in reversed(tables)]
    for t, df in tables.items():
        parts = [f"{quoted(c)} {TYPES.get(k, TEXT)}" for c, k in df.dtypes]
        parts += [f"{'UNIQUE' if i else 'PRIMARY KEY'} ({names(k)})" for i, k in enumerate(keys.get(t, ()))]
        parts += [f"FOREIGN KEY ({names(r.columns)}) REFERENCES {quoted(r.table)} ({names(r.key)}) ON DELETE CASCADE" for r in references.get(t, ())]
        lines.append(f"CREATE TABLE {quoted(t)} ({', '.join(parts)});")
    made = [f"CREATE INDEX {quoted(i)} ON {quoted(t)} ({names(columns)});" for i, (t, columns) in sorted((indexes or {}).items())]
    out = spark.createDataFrame([(k, x) for k, x in enumerate(lines)] + [(len(lines) + len(tables) + k, x) for k, x in enumerate(made)], "step int, statement string")
    for k, (t, df) in enumerate(tables.items()):
        out = out.unionByName(inserts(df, t).select(F.lit(len(lines) + k).alias("step"), "statement"))
    return out
