"""Column functions for URLs, dates, languages and text (all JVM-side).

Every function takes and returns a ``Column``; none is a Python UDF, so the
expressions stay inside whole-stage code generation.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import BOILERPLATE_PHRASES, LANGUAGE_NAMES

# Line breaks as Python's str.splitlines() knows them (CRLF first).
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{0085}\x{2028}\x{2029}]"
# Whitespace as Python's re ``\s`` knows it in Unicode mode.
WHITESPACE_RUN = (r"[\t\n\x0b\x0c\r \x1c-\x1f\x{0085}\x{00a0}\x{1680}"
                  r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")

# Its characters besides the space and the line feed, one by one.
RARE_WHITESPACE = tuple("\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
                        + "".join(map(chr, range(0x2000, 0x200b))))
# A class that holds all of these and some more: one search for it is one pass over a text.
MAYBE_WHITESPACE = r"[\t\x0b-\x0d\x1c-\x1f\x{0085}\x{00a0}\x{1680}-\x{3000}]"


def boilerplate_pattern(phrases=BOILERPLATE_PHRASES) -> str:
    return "(?i)(" + "|".join(phrases) + ")"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canon_domain(c) -> Column:
    """Text after the last ``//``, one leading ``www.`` dropped, ``/`` trimmed."""
    x = F.substring_index(_col(c), "//", -1)
    x = F.regexp_replace(x, r"^www\.", "")
    return F.regexp_replace(x, r"^/+|/+$", "")


def url_slug(c) -> Column:
    """Last path segment after stripping trailing ``/``; the url when empty."""
    u = _col(c)
    seg = F.substring_index(F.regexp_replace(u, "/+$", ""), "/", -1)
    return F.coalesce(F.nullif(seg, F.lit("")), u)


def url_host(c) -> Column:
    """Network location (host plus port) of an absolute url."""
    return F.regexp_extract(_col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def normalize_seendate(c) -> Column:
    """``YYYYMMDD...`` -> ``YYYY-MM-DD``; anything else unchanged."""
    x = _col(c)
    return F.when(
        x.rlike(r"^[0-9]{8}"),
        F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)),
    ).otherwise(x)


def normalize_publish_date(c) -> Column:
    """Remove every ``-`` then normalise as a seen-date."""
    return normalize_seendate(F.regexp_replace(_col(c), "-", ""))


def lang_hint(name, default) -> Column:
    """english -> en, french -> fr (case-insensitive), else default, else unknown."""
    mapping = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES for x in pair])
    return F.coalesce(F.element_at(mapping, F.lower(_col(name))),
                      F.nullif(_col(default), F.lit("")), F.lit("unknown"))


def keyword_query(keyword, domain) -> Column:
    """Quote a keyword that contains a space, then `` domainis:<domain>``."""
    k = _col(keyword)
    quoted = F.when(k.contains(" "), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    return F.concat(quoted, F.lit(" domainis:"), _col(domain))


def snapshot_url(stamp, url) -> Column:
    """Raw archived page address for a snapshot stamp."""
    return F.concat(F.lit("https://web.archive.org/web/"), _col(stamp), F.lit("id_/"),
                    _col(url))


def bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(x), f), 0)


def _holds_any(x: Column, texts) -> Column:
    return functools.reduce(operator.or_, [x.contains(t) for t in texts])


def _plain(phrase: str) -> bool:
    """Whether a boilerplate phrase means itself as a regular expression, in lower case."""
    return phrase == phrase.lower() and not set(phrase) & set("\\^$.|?*+()[]{}")


def collapse_whitespace(x: Column) -> Column:
    """Every run of whitespace as one space.

    Line feeds and pairs of spaces are replaced as plain text; the pattern only
    runs over what holds other whitespace or longer runs after that.
    """
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    for _ in range(2):
        x = F.replace(x, F.lit("  "), F.lit(" "))
    return bound(x, lambda t: F.when(t.contains("  ") | t.rlike(MAYBE_WHITESPACE),
                                     F.regexp_replace(t, WHITESPACE_RUN, " ")).otherwise(t))


def clean_text(c, phrases=BOILERPLATE_PHRASES) -> Column:
    """Drop boilerplate lines, join with a space, collapse whitespace, strip.

    Null or empty input gives the empty string. A text that holds no phrase at
    all (a plain substring search in its lower case, which finds every match of
    the pattern) has no line to drop: its lines are not searched one by one,
    and their breaks are whitespace like any other. Of the others, only the
    lines that hold a phrase meet the pattern.
    """
    x = _col(c)
    lines = F.split(x, LINE_BREAK)
    plain = phrases and all(_plain(p) for p in phrases)

    def dropped(ln: Column) -> Column:
        found = ln.rlike(boilerplate_pattern(phrases))
        return bound(F.lower(ln), lambda t: _holds_any(t, phrases)) & found if plain else found

    kept = F.array_join(F.filter(lines, lambda ln: ~dropped(ln)), " ")
    if plain:
        kept = F.when(bound(F.lower(x), lambda t: _holds_any(t, phrases)), kept).otherwise(x)
    return F.coalesce(F.trim(collapse_whitespace(kept)), F.lit(""))


def compose_text(title, body) -> Column:
    """``title + '. ' + body``, stripped of spaces."""
    return F.trim(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(". "),
                           F.coalesce(_col(body), F.lit(""))))


def parse_date(c) -> Column:
    """``yyyy-MM-dd`` text -> date; anything else -> null."""
    return F.try_to_date(_col(c), "yyyy-MM-dd")
