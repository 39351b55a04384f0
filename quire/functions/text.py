"""Column functions over document texts: counts, lines, folding, search words."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def nbytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def nlines(text: Column) -> Column:
    """Line feeds; an unterminated last line isn't counted."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def logical_lines(text: Column) -> Column:
    """Lines that edits may name: an unterminated last one counts."""
    return nlines(text) + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def nwords(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")).cast("bigint")


def lines(text: Column) -> Column:
    """Lines without their ends; a closing line feed opens no further line."""
    body = F.when(F.endswith(text, F.lit("\n")), F.substring(text, 1, F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, "\r$", "")))


def slice_lines(text: Column, first: int, last: int) -> Column:
    """Lines first to last (from 1, inclusive) with their ends; past the end is ignored; first 0 or last < first: empty."""
    if first < 1 or last < first:
        return F.lit("")
    kept = F.split(text, r"(?<=\n)")
    return F.array_join(F.slice(kept, first, last - first + 1), "")


@cache
def _folding() -> tuple[str, str]:
    """Accented lower-case Latin letters and their base letters, by canonical decomposition.

    Covers Latin-1, Latin Extended-A and a few of Extended-B. Strokes, which don't decompose, are the fixed exceptions.
    """
    #: fixed values: letters with a stroke or hook and their bases
    exceptions = {"ø": "o", "đ": "d", "ħ": "h", "ı": "i", "ł": "l", "ŧ": "t", "ſ": "s", "ŀ": "l", "ĸ": "k"}
    points = [*range(0xE0, 0x180), *range(0x1CE, 0x1DD), 0x1E3, 0x1E7, 0x1E9, 0x1EB, 0x1F5, 0x1F9]
    found = {}
    for c in map(chr, points):
        base = exceptions.get(c) or unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii() and c == c.lower() or c in exceptions:
            found[c] = base
    found["ǣ"] = "a"
    return "".join(found), "".join(found.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics, one character for one."""
    source, target = _folding()
    return F.translate(F.lower(text), source, target)


def fold_text(text: str) -> str:
    """fold() of a Python text."""
    source, target = _folding()
    return "".join(c.lower()[:1] for c in text).translate(str.maketrans(source, target))


def spaced_words(text: Column) -> Column:
    """The search words of a text, each between single spaces, as one text: ' a b '; a single space where there is none."""
    return F.replace(F.concat(F.lit(" "), F.regexp_replace(fold(text), r"[^\p{IsAlphabetic}\p{N}]+", " "), F.lit(" ")), F.lit("  "), F.lit(" "))


def search_words(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
