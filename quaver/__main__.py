"""Command line: build a store from a wiki and refresh its videos; search, statistics, report of records and SQL dump over a store or a folder of tables."""

from __future__ import annotations

import argparse
import json
import sys

from .operators import enrich, search, stats, store
from .operators.pages import Site
from .operators.versioned import Store
from .plans import params
from .session import session
from .sources import build as B
from .sources import catalog as C
from .sources.fetch import Policy, Progress, refresh_videos


def _number(least: float):
    def read(raw: str) -> float:
        try:
            return params.number(raw, int, least)
        except ValueError as e:
            raise argparse.ArgumentTypeError(str(e)) from None

    return read


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quaver", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("search", "stats", "report", "dump"):
        c = commands.add_parser(name)
        where = c.add_mutually_exclusive_group(required=True)
        where.add_argument("--data", help="folder of the tables")
        where.add_argument("--store", help="folder of a store that build has made")
        if name == "search":
            c.add_argument("--length", type=_number(0))
            c.add_argument("--year", type=_number(0))
            c.add_argument("--page", type=_number(1), default=1)
            c.add_argument("--page-size", type=int, choices=params.PAGE_SIZES, default=50)
            c.add_argument("--label", action="append", default=[])
            c.add_argument("--composer", default="")
            c.add_argument("--sort", choices=params.SORTS, default="popularity")
            c.add_argument("--columns", nargs="*", default=["artist", "published_year"])
        if name == "report":
            c.add_argument("--limit", type=_number(0), default=100)
            c.add_argument("--year", type=_number(2000), default=2026)
        if name == "dump":
            c.add_argument("--to", required=True)
    for name in ("build", "refresh"):
        c = commands.add_parser(name, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
        c.add_argument("--store", required=True, help="folder of the store")
        c.add_argument("--work", required=True, help="folder of what was fetched; a later run goes on with it")
        c.add_argument("--timeout", type=_seconds(False), default=Policy.timeout, help="seconds to wait for an answer")
        c.add_argument("--request-interval", type=_seconds(True), default=Policy.interval if name == "build" else 0.0, help="seconds between requests to a host")
        c.add_argument("--max-retries", type=_number(0), default=Policy.retries, help="retries of an answer that asks for patience")
        c.add_argument("--backoff-base", type=_seconds(True), default=Policy.base, help="seconds before the first retry")
        c.add_argument("--backoff-max", type=_seconds(True), default=Policy.most, help="longest wait")
        if name == "build":
            c.add_argument("--source-url", required=True, help="first page of the list of works")
            c.add_argument("--tag", type=_tag, action="append", default=[], help="a popularity tag and its score, as LABEL=SCORE; the first one counts among equals")
            c.add_argument("--tag-base", default="", help="what comes before a tag in the address of its list")
            c.add_argument("--site", type=json.loads, default={}, help="fields of pages.Site as JSON")
    return p


def _seconds(zero: bool):
    def read(raw: str) -> float:
        try:
            value = float(raw)
        except ValueError:
            value = -1.0
        if not (value > 0 or zero and value == 0) or value == float("inf"):
            raise argparse.ArgumentTypeError(f"a number of seconds {'from 0' if zero else 'above 0'} is wanted")
        return value

    return read


def _tag(raw: str) -> tuple[str, int]:
    label, _, score = raw.rpartition("=")
    if not label or not score.isdigit():
        raise argparse.ArgumentTypeError("LABEL=SCORE is wanted")
    return label, int(score)


def _fetching(a: argparse.Namespace) -> int:
    """build and refresh: 0 if all went well, 1 if something could not be had."""
    spark = session()
    store_, progress = Store(spark, a.store), Progress(spark)
    policy = Policy(a.timeout, a.request_interval, a.backoff_base, int(a.max_retries), a.backoff_max)
    say = lambda line: print(line, flush=True)
    with progress.told(say, 5.0):
        if a.command == "build":
            try:
                B.build(store_, a.source_url, a.work, tuple(a.tag), a.tag_base, Site(**{k: tuple(v) if isinstance(v, list) else v for k, v in a.site.items()}), policy, progress=progress, say=say)
            except B.Incomplete as e:
                print(e, file=sys.stderr)
                return 1
        else:
            if not store_.numbers():
                print(f"there is no store at {a.store}", file=sys.stderr)
                return 1
            done, sums = refresh_videos(store_, "details", a.work, policy, progress=progress)
            say(json.dumps(sums | {"records": done.counts.get("rows", 0), "entries": done.counts.get("updated", 0)}))
    store_.vacuum()
    return 0


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command in ("build", "refresh"):
        return _fetching(a)
    c = C.catalog(session(), a.data) if a.data else B.catalog(Store(session(), a.store).snapshot())
    if a.command == "search":
        p = params.SearchParams(a.length, a.sort, tuple(a.label), a.composer.strip(), a.year, a.page, a.page_size)
        known = tuple(r[0] for r in stats.by_label(c.songs).select("popularity_label").collect())  # a handful of labels
        print(" / ".join(params.criteria(p, known, ())))
        filters = {"length": p.length, "labels": p.labels, "composer": p.composer, "year": p.year}
        rows = search.search(c, p.sort, p.page_size, p.offset, **filters)
        for r in search.tsv(rows, tuple(a.columns)).collect():  # one page
            print(r.line)
        print(json.dumps(params.paging(search.total(c, **filters).first().total, p.page, p.page_size)))
    elif a.command == "stats":
        for name, df in stats.statistics(c).items():
            print(json.dumps({name: [r.asDict() for r in df.limit(1000).collect()]}, ensure_ascii=False))
    elif a.command == "report":
        for r in enrich.issue_report(c, a.year, a.limit).collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        tables = {"songs": c.songs, "details": c.details, "people": c.people}
        keys, to = {"songs": (("song_url",),), "details": (("url",),)}, lambda column: (store.Reference((column,), "songs", ("song_url",)),)
        store.dump(tables, keys=keys, references={"details": to("url"), "people": to("song_url")}).orderBy("step").select("statement").write.text(a.to)
    return 0


if __name__ == "__main__":
    sys.exit(main())
