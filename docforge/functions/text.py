"""Canonical text forms, keys and ratios.

Patterns are spelt so that Java and RE2 agree: letters and digits are ``[\\p{L}\\p{N}]``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
NOT_WORD_OR_LOW_LINE = r"[^\p{L}\p{N}_]+"
PAGE_NUMBER = r"(?i)^\s*(?:[-–—·•]*\s*)?(?:\d{1,4}|[ivxlcdm]{1,8})(?:\s*[-–—·•]*)?\s*$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """A column of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def canonical(c: Column) -> Column:
    """Line ends as LF, blanks squeezed in each line, none at the ends."""
    lines = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"), "\n")
    return stripped(F.array_join(F.transform(lines, squeezed), "\n"))


def paragraphs(c: Column) -> Column:
    """Canonical non-empty paragraphs, cut at blank lines."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), canonical), lambda p: p != "")


#: The signs that compact() drops: white space of Java's patterns, and those named there.
NO_SIGNS = (*" \t\n\x0b\f\r", "\u3000", "\u200b", "\ufeff")


def compact(c: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(c), "[\\s　​﻿]+", "")


#: Presentation forms and what they stand for: dashes, curly quotes, and full-width forms of ASCII (the part of NFKC that extraction meets).
_FORMS = {**dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-"), **dict.fromkeys("\u2018\u2019\u201a\u201b", "'"), **dict.fromkeys("\u201c\u201d\u201e\u201f", '"'), **{chr(0xFEE0 + i): chr(i) for i in range(0x21, 0x7F)}}


def presented(c: Column) -> Column:
    """Plain dashes, quotes and widths, ligatures of f written out, no soft hyphens, white space squeezed."""
    bare = F.translate(c, "".join(_FORMS) + "\u00ad", "".join(_FORMS.values()))
    return squeezed(F.regexp_replace(F.regexp_replace(bare, "\ufb01", "fi"), "\ufb02", "fl"))


def plain(c: Column) -> Column:
    """Lower-case words joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), NOT_WORD_OR_LOW_LINE, " "))


def repeat_key(c: Column) -> Column:
    """Key of a line of under 60 characters, free of punctuation and blanks; empty for longer ones."""
    return F.when(F.length(stripped(c)) < 60, F.regexp_replace(F.lower(c), NOT_WORD, "")).otherwise("")


def margin_key(c: Column) -> Column:
    """Key of a header or footer line: digits and punctuation as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+", " "), NOT_WORD_OR_LOW_LINE, " "))


def is_page_number(c: Column) -> Column:
    return c.rlike(PAGE_NUMBER)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def alphanum_ratio(c: Column) -> Column:
    """Share of letters and digits; 1 for an empty text."""
    return F.when(F.length(c) == 0, F.lit(1.0)).otherwise(F.regexp_count(c, F.lit(r"[\p{L}\p{N}]")) / F.length(c))


def space_ratio(c: Column) -> Column:
    """Runs of white space over characters; 1 for an empty text."""
    return F.when(F.length(c) == 0, F.lit(1.0)).otherwise(F.regexp_count(c, F.lit(r"\s+")) / F.length(c))


def newline_ratio(c: Column) -> Column:
    """Runs of line ends over characters; 1 for an empty text."""
    return F.when(F.length(c) == 0, F.lit(1.0)).otherwise(F.regexp_count(c, F.lit("\n+")) / F.length(c))


def slug(c: Column, default: str = "source") -> Column:
    """ASCII slug."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def unicode_slug(c: Column, limit: int = 30) -> Column:
    """Slug that keeps letters of all scripts, cut to a length."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), NOT_WORD, "_"), "^_+|_+$", "")
    return F.regexp_replace(F.substring(s, 1, limit), "_+$", "")


def heading_level(c: Column) -> Column:
    """2 for ``(一)``-like starts, 3 for ``1.``-like ones, else 1."""
    return F.when(c.rlike(r"^[(（][一二三四五六七八九十\d]+[)）]"), 2).when(c.rlike(r"^\d+[.．、]"), 3).otherwise(1).cast("long")


def yaml_escaped(c: Column) -> Column:
    """Quoted where a YAML scalar needs it."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"'))
    return F.when(c.rlike(r"[:#\[\]{},&*!|>'\"%@`]|^\s|\s$|^$"), quoted).otherwise(c)


def timestamp_label(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.concat(two(F.floor(s / 60)), F.lit(":"), two(s % 60))
    return F.when(s >= 3600, F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))).otherwise(short)
