"""Search parameters: parsing and validation, with the messages that callers see (P-10, P-11, O-16, O-22)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

SORTS = ("popularity", "title_length_asc", "title_length_desc", "published_year_asc", "published_year_desc")
PAGE_SIZES = (50, 100, 200)


@dataclass(frozen=True)
class SearchParams:
    length: int | None = None
    sort: str = "popularity"
    labels: tuple[str, ...] = ()
    composer: str = ""
    year: int | None = None
    page: int = 1
    page_size: int = 50

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.page_size


def optional_integer(name: str, raw: str | None) -> int | None:
    return None if raw in (None, "") else required_integer(name, raw, 0)


def required_integer(name: str, raw: str, least: int) -> int:
    if not re.fullmatch(r"[0-9]+", raw):
        raise ValueError(f"{name} must be an integer")
    if int(raw) < least:
        raise ValueError(f"{name} must be {least} or greater")
    return int(raw)


def parse(query: dict[str, list[str]], known_labels: set[str] | None = None) -> SearchParams:
    one = lambda k, d=None: query.get(k, [d])[0]
    sort = one("sort", "popularity")
    if sort not in SORTS:
        raise ValueError("sort is not supported")
    size = required_integer("page_size", one("page_size", "50"), 1)
    if size not in PAGE_SIZES:
        raise ValueError("page_size must be one of " + ", ".join(map(str, PAGE_SIZES)))
    labels = tuple(query.get("popularity_label", ()))
    if known_labels is not None and set(labels) - known_labels:
        raise ValueError("popularity_label is not supported")
    return SearchParams(optional_integer("length", one("length")), sort, labels, (one("composer", "") or "").strip(), optional_integer("year", one("year")), required_integer("page", one("page", "1"), 1), size)


def paging(total: int, page: int, size: int) -> dict[str, int]:
    """O-22."""
    return {"total_pages": max(1, math.ceil(total / size)), "start": (page - 1) * size + 1 if total else 0, "end": min(page * size, total)}


def number(raw: str, kind: type = int, least: float = 0, more: bool = False) -> float:
    """P-11: a number of ``kind`` that is at least ``least``, or with ``more`` above it; for command lines."""
    what = f"{'a whole number' if kind is int else 'a number'} {'above' if more else 'of at least'} {least:g}"
    try:
        value = kind(raw)
    except ValueError:
        raise ValueError(f"must be {what}") from None
    if not (value > least if more else value >= least):
        raise ValueError(f"must be {what}")
    return value


#: Names of the orders as shown, and the label that is left out by default.
SORT_NAMES = {"popularity": "人気度順", "title_length_asc": "文字数昇順", "title_length_desc": "文字数降順", "published_year_asc": "公開年昇順", "published_year_desc": "公開年降順"}
TOP_LABEL = "殿堂入り"


def label_summary(chosen: tuple[str, ...], known: tuple[str, ...], top: str = TOP_LABEL) -> str:
    """X-34: the chosen labels in short."""
    if not chosen:
        return "根拠タグ: 指定なし"
    if known and len(chosen) == len(known):
        return "全タグ"
    without_top = top in known and top not in chosen
    if without_top and len(chosen) + 1 == len(known):
        return f"{top}除外"
    named = len(chosen) <= 2 and not without_top
    return "根拠タグ: " + (" / ".join(chosen) if named else f"{len(chosen)}件")


def criteria(p: SearchParams, known: tuple[str, ...], default: tuple[str, ...], from_statistics: bool = False) -> list[str]:
    """X-34: what a search was for, as short texts."""
    said = [
        (from_statistics, "統計から適用"),
        (p.length is not None, f"{p.length}文字"),
        (p.composer, f"作曲者: {p.composer}"),
        (p.year is not None, f"公開年: {p.year}"),
        (set(p.labels) != set(default), label_summary(p.labels, known)),
        (True, SORT_NAMES[p.sort]),
    ]
    return [text for true, text in said if true]
