"""Unicode text rules as Column expressions; vectorised UDFs only for what Spark lacks (normal forms, HTML entities)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.isspace and str.split see it, for Java character classes.
SPACES = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Characters that look blank and are not counted in titles.
BLANKS = "".join(map(chr, (0x200B, 0x200C, 0x2060, 0xFEFF, 0x2800)))
#: Characters that never join their neighbours into one cluster (but CR LF, which is white space): Latin, common punctuation, kana, ideographs.
SINGLE = "\\x00-\u02FF\u2010-\u2027\u3000-\u3029\u3041-\u3096\u30A0-\u30FF\u4E00-\u9FFF\uFF01-\uFF60"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """X-1: Unicode NFC."""
    return s.map(lambda x: x if x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def credit_name(s: pd.Series) -> pd.Series:
    """X-2: NFKC, case folding, strip."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold().strip(), na_action="ignore")


@F.pandas_udf(T.StringType())
def unescaped_title(s: pd.Series) -> pd.Series:
    """X-7: HTML entities, NFC, strip."""
    return s.map(lambda x: unicodedata.normalize("NFC", html.unescape(x)).strip(), na_action="ignore")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def grapheme_clusters(c: Column) -> Column:
    """X-4: extended grapheme clusters."""
    return F.regexp_extract_all(c, F.lit(r"(\X)"), F.lit(1))


def title_length(c: Column) -> Column:
    """X-5: grapheme clusters that are neither white space nor blank characters alone; the text is taken as NFC."""
    # each cluster gets an end mark, uncounted ones go, marks are counted: no array of clusters is made
    marked = F.regexp_replace(F.translate(c, "\x01", "\x02"), r"(\X)", "$1\x01")
    counted = F.regexp_replace(marked, f"(?:^|(?<=\x01))(?:[{SPACES}]+|[{BLANKS}]+)\x01", "")
    slow = F.length(counted) - F.length(F.translate(counted, "\x01", ""))
    # where every character is a cluster of its own, they are counted without being taken apart
    return F.when(c.rlike(f"[^{SINGLE}]"), slow).otherwise(F.length(F.regexp_replace(c, f"[{SPACES}]+", "")))


def title_parts(c: Column) -> dict[str, Column]:
    """X-6: title, artist and note around the first two slashes; a text without any is left as it is."""
    parts = F.split(c, "/", 3)
    part = lambda k: strip(F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit("")))
    return {"title": F.when(F.instr(c, "/") == 0, c).otherwise(part(1)), "artist": part(2), "artist_note": part(3)}


def clean_text(c: Column) -> Column:
    """X-8: every run of white space becomes one space; ends are stripped."""
    return F.trim(F.regexp_replace(c, f"[{SPACES}]+", " "))


def useful_lines(c: Column) -> Column:
    """X-9: cleaned lines that are not empty."""
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85" + chr(0x2028) + chr(0x2029) + "]"), clean_text), lambda x: x != "")


def unique(c: Column) -> Column:
    """U-2: distinct non-empty strings in order of first appearance."""
    return F.array_distinct(F.filter(c, lambda x: x != ""))


def like_escaped(c: Column) -> Column:
    """X-3: backslash before the wildcards of LIKE."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def url_decoded(c: Column) -> Column:
    """X-10: percent-decoding that leaves plus signs alone, and percent signs that begin no code."""
    return F.try_url_decode(F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def sql_literal(c: Column) -> Column:
    """X-22: a quoted SQL string."""
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def parenthesis_balance(c: Column) -> Column:
    """X-25: opening minus closing parentheses of both widths."""
    count = lambda chars: F.length(c) - F.length(F.translate(c, chars, ""))
    return count("(（") - count(")）")


def without_parentheses(c: Column) -> Column:
    """X-27: a value that is one parenthetical loses its first and last character."""
    return F.when(c.rlike(r"^[(（].*[)）]$"), strip(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)


def host(c: Column) -> Column:
    """X-31: host of a URL or bare domain, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^[a-z][a-z0-9+.-]*://", ""), r"[/:?#].*$", "")


def slug(c: Column) -> Column:
    """X-29: heading anchors."""
    return F.regexp_replace(strip(F.regexp_replace(F.lower(c), r"(?U)[^\w\-\x{3040}-\x{30ff}\x{3400}-\x{9fff} ]+", "")), r"(?U)\s+", "-")


def utc_now(now: Column | None = None) -> Column:
    """X-23: a moment as ISO 8601 in UTC, to the second; the time of the query by default."""
    moment = F.current_timestamp() if now is None else now
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), moment.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def whole_number(c: Column) -> tuple[Column, Column]:
    """X-24: the number, and what is wrong if the text is none."""
    n = c.try_cast("bigint")
    return n, F.when(c.isNotNull() & n.isNull(), F.concat(F.lit("not a whole number: "), c))


def _folds() -> dict[str, str]:
    """Letters that case folding, unlike lower case, turns into something with an ASCII letter."""
    every = (chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000)
    return {x: x.casefold() for x in every if x.casefold() != x.lower() and any(y.isascii() for y in x.casefold())}


FOLDS = _folds()


def folded(c: Column) -> Column:
    """X-28: case folding, as far as it can decide whether a text holds a word of ASCII letters or of letters without case."""
    for old, new in FOLDS.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.lower(c)
