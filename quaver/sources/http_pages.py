"""Pages as a Spark data source, batch and streaming: ``spark.read.format("quaver_pages").load(folder)`` (S-7, S-10).

:func:`list_urls` writes a folder of urls: numbered batches, parted by host.  The source makes a partition of each host
(of each batch, for a stream, whose offset is the number of the last batch).  The driver sees names of hosts and files
only; a partition reads its own urls, paces them, and keeps one connection to its host for as long as the server lets it.

Options: ``timeout``, ``interval``, ``base``, ``retries``, ``most``, ``agent`` as in :class:`fetch.Policy`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import fields
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.store import _files, names_in
from .fetch import SCHEMA, Client, Connections, Policy

NAME = "quaver_pages"
_BATCH = re.compile(r"\d{9}")


def list_urls(urls: DataFrame, folder: str) -> int | None:
    """Write the distinct urls that ``folder`` lacks as its next batch; its number, or None where there are none. One writer at a time."""
    spark = urls.sparkSession
    host = F.coalesce(F.try_parse_url("url", F.lit("AUTHORITY")), F.lit(""))
    wanted = urls.select("url").filter("url is not null").distinct()
    done = batches(spark, folder)
    if done:
        known = spark.read.text([f"{folder}/{b}" for b in done]).select(F.col("value").alias("url"))
        wanted = wanted.join(known, "url", "left_anti")
    name = f"{int(done[-1]) + 1 if done else 0:09d}"
    # a url with a line end cannot be asked for; it would be cut into two
    wanted.filter(~F.col("url").rlike(r"[\r\n]")).withColumn("host", host).repartition("host").write.partitionBy("host").text(f"{folder}/{name}")
    if any(x.startswith("host=") for x in names_in(spark, f"{folder}/{name}")):
        return int(name)
    place, files = _files(spark, f"{folder}/{name}")
    files.delete(place, True)
    return None


def batches(spark: SparkSession, folder: str) -> list[str]:
    """Names of the whole batches, in order."""
    return [x for x in names_in(spark, folder) if _BATCH.fullmatch(x) and "_SUCCESS" in names_in(spark, f"{folder}/{x}")]


class HostPartition(InputPartition):
    """Files of urls of one host."""

    def __init__(self, host: str, paths: list[str]):
        super().__init__(host)
        self.host, self.paths = host, paths


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder: a uri of any kind that pyarrow knows, or a local path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class _Pages:
    """What both readers share."""

    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.folder = given["path"].rstrip("/")
        self.policy = Policy(**{f.name: type(f.default)(given[f.name]) for f in fields(Policy) if f.name in given})

    def numbers(self) -> list[int]:
        files, path = _opened(self.folder)
        names = [x.base_name for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if _BATCH.fullmatch(x.base_name)]
        whole = files.get_file_info([f"{path}/{n}/_SUCCESS" for n in names])
        return sorted(int(n) for n, x in zip(names, whole) if x.type == fs.FileType.File)

    def hosts(self, numbers: list[int]) -> list[HostPartition]:
        files, path = _opened(self.folder)
        found: dict[str, list[str]] = {}
        for n in numbers:
            for x in files.get_file_info(fs.FileSelector(f"{path}/{n:09d}", recursive=True)):
                host = re.search(r"/host=([^/]*)/part-[^/]*$", x.path)
                if host and x.type == fs.FileType.File:
                    found.setdefault(host[1], []).append(x.path)
        return [HostPartition("" if h == "__HIVE_DEFAULT_PARTITION__" else unquote(h), sorted(p)) for h, p in sorted(found.items())]

    def rows(self, partition: HostPartition) -> Iterator[tuple]:
        files, _ = _opened(self.folder)
        with Connections() as connections:
            client = Client(self.policy, connections)
            for path in partition.paths:
                with files.open_input_stream(path) as lines:
                    for line in _lines(lines):
                        yield client.get(line)


def _lines(stream) -> Iterator[str]:
    rest = b""
    while block := stream.read(1 << 16):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.decode() for x in whole)
    if rest:
        yield rest.decode()


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[HostPartition]:
        return self.hosts(self.numbers()) or [HostPartition("", [])]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        return self.rows(partition)


class PageStreamReader(_Pages, DataSourceStreamReader):
    """An offset is the number of batches that lie before it."""

    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        return {"batches": max(self.numbers(), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[HostPartition]:
        own = [n for n in self.numbers() if start["batches"] <= n < end["batches"]]
        return self.hosts(own) or [HostPartition("", [])]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Batches stay: they tell which urls were asked for."""


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def pages(spark: SparkSession, folder: str, policy: Policy = Policy()) -> DataFrame:
    """A row of ``fetch.SCHEMA`` for each listed url; asked for again whenever it is evaluated."""
    register(spark)
    return spark.read.format(NAME).options(**_options(policy)).load(folder)


def page_stream(spark: SparkSession, folder: str, policy: Policy = Policy()) -> DataFrame:
    """The pages of each batch of urls as it is listed."""
    register(spark)
    return spark.readStream.format(NAME).options(**_options(policy)).load(folder)


def _options(policy: Policy) -> dict[str, str]:
    return {f.name: str(getattr(policy, f.name)) for f in fields(Policy)}
