"""Normalisers of names, numbers and years, as Python functions and as columns that agree with them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSUS = r"(?:v|vs|c)\.?"
OTHER = re.compile(r"[\W_]+")


#: Code points of names whose normal forms are remembered.
SHORT = 64


def fold(s: str | None) -> str:
    """A name's letters and digits in lower case: the key under which registries are looked up."""
    return _folded(s) if s and len(s) <= SHORT else _folded.__wrapped__(s or "")


@lru_cache(maxsize=10_000)
def _folded(s: str) -> str:
    return "".join(c for c in s if c.isalnum()).lower()


def fold_column(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]", ""))


def plain(s: str | None) -> str:
    """Lower case without accents, punctuation as spaces, single spaces."""
    return _plain(s) if s and len(s) <= SHORT else _plain.__wrapped__(s or "")


@lru_cache(maxsize=10_000)
def _plain(s: str) -> str:
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        s = "".join(c for c in s if not unicodedata.combining(c))
    return " ".join(OTHER.sub(" ", s.casefold()).split())


def ident(s: str | None) -> str | None:
    """An identifier: compatibility form, lower case, other characters than letters, digits and inner points as one hyphen."""
    s = unicodedata.normalize("NFKC", s or "").lower().strip()
    s = re.sub(r"[‐‑‒–—−]", "-", s)
    s = re.sub(r"[^\w.]+", "-", s)
    return re.sub(r"(^[-.]+)|([-.]+$)", "", s) or None


def num(s: str | None) -> str | None:
    """A number without leading zeros; what is no number is an identifier."""
    s = (s or "").strip()
    return (s.lstrip("0") or "0") if s.isdecimal() else ident(s)


def num_column(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), F.regexp_replace(c, r"^0+(?=\d)", "")).otherwise(F.lower(F.regexp_replace(F.trim(c), r"[^\p{IsAlphabetic}\p{N}.]+", "-")))


def year(s: str | None, pivot: int = 50) -> str | None:
    """A year of four digits; of two digits, those up to the pivot are of this century."""
    s = (s or "").strip()
    if re.fullmatch(r"\d{4}", s):
        return s
    if re.fullmatch(r"\d{2}", s):
        return ("20" if int(s) <= pivot else "19") + s
    return None


def is_year(s: str | None, latest: int) -> bool:
    """Whether a year can be of a decision: from 1600 to the year after the latest."""
    return bool(s) and s.isdecimal() and 1600 <= int(s) <= latest + 1


def utf16_length(s: str) -> int:
    return len(s) + sum(ord(c) > 0xFFFF for c in s)


def convert_offset(text: str, at: int, unit: str) -> int:
    """A place in code points as one in bytes or UTF-16 units."""
    if not 0 <= at <= len(text):
        raise ValueError(f"invalid_offset: {at}")
    head = text[:at]
    return {"char": at, "byte": len(head.encode()), "utf16": utf16_length(head)}[unit]


def offset_columns(text: Column, at: Column) -> dict[str, Column]:
    """The place at (code points) in each unit."""
    head = F.substring(text, F.lit(1), at)
    return {"char": at, "byte": F.octet_length(head), "utf16": at + F.length(F.regexp_replace(head, r"[^\x{10000}-\x{10FFFF}]", ""))}


def spans_column(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of a pattern's matches, in code points; the pattern must not match an empty string.

    start is what all earlier pieces and matches add up to.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    length = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    each = F.transform(
        F.sequence(F.lit(0), F.size(found) - 1),
        lambda i: F.struct((length(pieces, i + 1) + length(found, i)).alias("start"), (length(pieces, i + 1) + length(found, i + 1)).alias("end"), F.get(found, i).alias("text")),
    )
    return F.when(F.size(found) > 0, each).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def within_one_edit(a: str, b: str) -> bool:
    return edits(a, b, 1) <= 1


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], most + 1)
