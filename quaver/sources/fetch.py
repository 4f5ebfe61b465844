"""Pages over HTTP as DataFrames: paced by host, retried, resumable (S-7 to S-10, S-21, S-22, X-33, N-3, N-8).

The requests of a host meet in one task, which paces them; hosts are fetched side by side.  An ``opener`` makes one
request and can be replaced.  Urls are made distinct first, so nothing is asked for twice.
"""

from __future__ import annotations

import http.client
import re
import threading
import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, enrich, pages, scans, stats, store
from ..operators.versioned import Commit, Store

#: States after which a request is made again.
RETRIED = (429, 502, 503, 504)
MOVED = (301, 302, 303, 307, 308)
#: Redirects of one request.
HOPS = 10
SCHEMA = "url string, status int, body string, error string, attempts int"
Answer = tuple[int, Mapping[str, str], bytes]
Opener = Callable[[str, "Policy"], Answer]


@dataclass(frozen=True)
class Policy:
    """Seconds to wait for an answer, between requests of a host, and before the first retry; retries; the longest wait."""

    timeout: float = 20.0
    interval: float = 0.2
    base: float = 2.0
    retries: int = 2
    most: float = 30.0
    agent: str = "quaver/1.0"


class Connections:
    """S-7: requests of one task over connections that are kept open, one to each host; redirects are followed."""

    def __init__(self):
        self.kept: dict[tuple[str, str], http.client.HTTPConnection] = {}
        self.opened = 0

    def __enter__(self) -> Connections:
        return self

    def __exit__(self, *_) -> None:
        for c in self.kept.values():
            c.close()
        self.kept.clear()

    def __call__(self, url: str, policy: Policy) -> Answer:
        for _ in range(HOPS):
            status, headers, body = self._asked(url, policy)
            if status not in MOVED or not headers.get("Location"):
                return status, headers, body
            url = urljoin(url, headers["Location"])
        raise ValueError(f"more than {HOPS} redirects")

    def _asked(self, url: str, policy: Policy) -> Answer:
        parts = urlsplit(url)
        kinds = {"http": http.client.HTTPConnection, "https": http.client.HTTPSConnection}
        if parts.scheme not in kinds or not parts.netloc:
            raise ValueError(f"no web address: {url}")
        path = quote(urlunsplit(("", "", parts.path or "/", parts.query, "")), safe="/%:=&?~#+!$,;'@()*[]")
        at = parts.scheme, parts.netloc
        for again in (False, True):
            known = self.kept.get(at)
            if known is None:
                known = self.kept[at] = kinds[parts.scheme](parts.netloc.rpartition("@")[2], timeout=policy.timeout)
                self.opened += 1
                again = True
            try:
                known.request("GET", path, headers={"User-Agent": policy.agent})
                answer = known.getresponse()
                body = answer.read()
            except (http.client.HTTPException, OSError) as e:
                self.kept.pop(at).close()
                # a server may close a connection that rested; one that never worked is not tried again
                if again or isinstance(e, TimeoutError):
                    raise
                continue
            if answer.will_close:
                self.kept.pop(at).close()
            return answer.status, answer.headers, body
        raise AssertionError


def text_of(headers: Mapping[str, str], body: bytes) -> str:
    """The body by the charset of its header, else UTF-8; bytes that are none of it are replaced."""
    named = re.search(r"charset=[\"']?([\w.:-]+)", headers.get("Content-Type") or "", re.I)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def asked_wait(value: str | None, now: datetime) -> float | None:
    """X-33: seconds that a Retry-After header asks for, as a number or a date; None if it tells neither."""
    value = (value or "").strip()
    if re.fullmatch("[0-9]+", value):
        return float(value)
    try:
        until = parsedate_to_datetime(value)
    except ValueError:
        return None
    return max(0.0, (until.replace(tzinfo=until.tzinfo or timezone.utc) - now).total_seconds())


class Client:
    """The requests of one task."""

    def __init__(self, policy: Policy, opener: Opener | None = None, sleep=time.sleep, clock=time.monotonic):
        self.policy, self.opener, self.sleep, self.clock = policy, opener or Connections(), sleep, clock
        self.free_from: dict[str, float] = {}

    def _paced(self, url: str) -> Answer:
        """S-8."""
        host = urlsplit(url).netloc
        self.sleep(max(0.0, self.free_from.get(host, 0.0) - self.clock()))
        self.free_from[host] = self.clock() + self.policy.interval
        return self.opener(url, self.policy)

    def get(self, url: str) -> tuple[str, int | None, str | None, str | None, int]:
        """S-9: a row of SCHEMA."""
        for attempt in range(1, self.policy.retries + 2):
            try:
                status, headers, body = self._paced(url)
            except (OSError, ValueError, http.client.HTTPException) as e:  # no answer, or no url
                return url, None, None, f"{type(e).__name__}: {e}", attempt
            if status < 400:
                return url, status, text_of(headers, body), None, attempt
            if status not in RETRIED or attempt > self.policy.retries:
                return url, status, None, f"HTTP {status}", attempt
            asked = asked_wait((headers or {}).get("Retry-After"), datetime.now(timezone.utc))
            self.sleep(min(self.policy.most, self.policy.base * 2.0 ** (attempt - 1) if asked is None else asked))
        raise AssertionError


class Progress:
    """N-3, S-21: what a fetch has done so far, to be read while it runs.

    ``done``, ``failed`` and ``retries`` are accumulators that move as tasks end.  ``total``, ``success`` and ``failure``
    are observed metrics of the finished passes: tasks that failed and ran again count once.
    """

    def __init__(self, spark: SparkSession):
        self._live = {k: spark.sparkContext.accumulator(0) for k in ("done", "failed", "retries")}
        self.began = time.monotonic()
        self.asked = 0
        self.passes: list[dict[str, int]] = []

    def add(self, row: tuple) -> None:
        """In a task: one answered url."""
        self._live["done"].add(1)
        self._live["failed"].add(int(row[3] is not None))
        self._live["retries"].add(row[4] - 1)

    def __getstate__(self) -> dict:
        return {"_live": self._live, "began": 0.0, "asked": 0, "passes": []}

    def __getattr__(self, name: str) -> int:
        if name in ("done", "failed", "retries"):
            return self._live[name].value
        if name in ("total", "success", "failure"):
            return sum(p[name] for p in self.passes)
        raise AttributeError(name)

    def line(self) -> str:
        took = max(time.monotonic() - self.began, 1e-9)
        return f"{self.done}/{self.asked} ({self.done / took:.2f} a second, {self.failed} failed)"

    @contextmanager
    def told(self, tell: Callable[[str], None] | None, every: float = 1.0) -> Iterator[None]:
        """Calls ``tell`` with a line whenever the counts have moved, until the block ends."""
        if tell is None:
            yield
            return
        over = threading.Event()

        def watch():
            last = None
            while not over.wait(every):
                if self.done != last:
                    last = self.done
                    tell(self.line())

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()
            tell(self.line())


def fetched(urls: DataFrame, policy: Policy = Policy(), opener: Opener | None = None, progress: Progress | None = None) -> DataFrame:
    """A row of SCHEMA for each distinct url; asked for again whenever it is evaluated, hence :func:`fetch_into`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Connections() as connections:
            client = Client(policy, opener or connections)
            for b in batches:
                got = []
                for u in b["url"]:
                    got.append(client.get(u))
                    if progress:
                        progress.add(got[-1])
                yield pd.DataFrame(got, columns=["url", "status", "body", "error", "attempts"]).astype({"status": "Int32", "attempts": "int32"})

    wanted = urls.select("url").filter("url is not null").distinct()
    return wanted.repartition(urls.sparkSession.sparkContext.defaultParallelism, F.try_parse_url("url", F.lit("HOST"))).mapInPandas(run, SCHEMA)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`fetch_into` has stored."""
    return spark.read.schema(SCHEMA).parquet(path) if store.table_exists(spark, path) else spark.createDataFrame([], SCHEMA)


def fetch_into(urls: DataFrame, path: str, policy: Policy = Policy(), opener: Opener | None = None, passes: int = 3, commits: int = 1, progress: Progress | None = None) -> DataFrame:
    """S-21: fetch what ``path`` lacks and append it, in up to ``passes`` passes of ``commits`` jobs each; the urls that remain."""
    spark = urls.sparkSession
    wanted = urls.select("url").filter("url is not null").distinct()
    left = lambda: wanted.join(answers(spark, path).select("url"), "url", "left_anti")
    for _ in range(passes):
        todo = left()
        n = todo.count()
        if not n:
            break
        if progress:
            progress.asked += n
        for k in range(commits):
            own, watch = todo.filter(F.pmod(F.xxhash64("url"), F.lit(commits)) == k), Observation()
            told = fetched(own, policy, opener, progress).observe(watch, F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failure"))
            told.filter("error is null").write.mode("append").parquet(path)
            if progress:
                progress.passes.append(watch.get)
    return left()


def tag_hits(tags: DataFrame, path: str, site: pages.Site = pages.Site(), policy: Policy = Policy(), opener: Opener | None = None, only_pages: int = 0, passes: int = 1) -> DataFrame:
    """S-10, S-22, P-9, W-2: (title, tag, tag_rank, score, position, song_url) of the works that each tag's pages list.

    tags: tag, tag_rank, score, url of the first page.  Pages are as many as the first one tells, or ``only_pages``.
    A tag of which a page cannot be had is left out; the others stay.
    """
    spark = tags.sparkSession
    fetch_into(tags, path, policy, opener, passes)
    last = corpus.last_page(F.col("body")) if not only_pages else F.lit(only_pages)
    every = tags.join(answers(spark, path), "url").select("tag", "tag_rank", "score", F.posexplode(corpus.page_urls(F.col("url"), last)).alias("page", "url"))
    fetch_into(every, path, policy, opener, passes)
    got = answers(spark, path).select("url", F.col("body").alias("html"))
    failed = every.join(got.select("url"), "url", "left_anti").select("tag").distinct()
    listed = pages.listed(got, site).join(every.join(failed, "tag", "left_anti"), "url")
    works = scans.works(listed.withColumn("raw", F.col("title")).withColumn("title", X.title_parts(F.col("raw"))["title"]), corpus.NOT_WORKS)
    first = works.groupBy("tag", "tag_rank", "score", F.col("raw").alias("title")).agg(F.min_by(F.struct("page", "position", "song_url"), F.struct("page", "position")).alias("r"))
    rows = first.select("tag", "tag_rank", "score", "title", "r.*").withColumnRenamed("position", "place")
    return stats.numbered(rows, "position", ["tag"], ["page"], "place").select("title", "tag", "tag_rank", "score", "position", "song_url")


def metadata_url(service: Column, video_id: Column) -> Column:
    """Where the two services tell of a video."""
    first = F.concat(F.lit("https://ext.nicovideo.jp/api/getthumbinfo/"), F.url_encode(video_id))
    second = F.concat(F.lit("https://www.youtube.com/oembed?url="), F.url_encode(F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)), F.lit("&format=json"))
    return F.when(service == "niconico", first).otherwise(second)


def video_metadata(ids: DataFrame, path: str, policy: Policy = Policy(interval=0.0), opener: Opener | None = None, passes: int = 1, progress: Progress | None = None) -> DataFrame:
    """N-3: (service, id, title, thumbnail_url) of the videos (service, id) whose service answered."""
    wanted = ids.select("service", "id").distinct().withColumn("url", metadata_url(F.col("service"), F.col("id")))
    fetch_into(wanted, path, policy, opener, passes, progress=progress)
    told = wanted.join(answers(ids.sparkSession, path).select("url", "body"), "url").withColumn("r", enrich.answer("service", "id", "body"))
    return told.select("service", "id", "r.*")


def refresh_videos(kept: Store, name: str, path: str, policy: Policy = Policy(interval=0.0), opener: Opener | None = None, passes: int = 1, progress: Progress | None = None) -> tuple[Commit, dict[str, int]]:
    """N-1 to N-8 and S-17: ask the services for the videos of stored records, and store what they tell.

    The write, which counts records and entries, and the sums of :func:`enrich.fetch_summary` over both services.
    """
    ids = enrich.video_ids(kept.snapshot().table(name))
    told = video_metadata(ids, path, policy, opener, passes, progress)
    sums = enrich.fetch_summary(ids, told).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "success", "failure", "fallback"))).first()
    return enrich.refreshed(kept, name, told), sums.asDict()
