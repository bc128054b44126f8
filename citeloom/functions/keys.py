"""Identity keys of citations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold, fold_column, ident, num, num_column, year
from ..schema import KEY_VERSION
from ..sources.registry import SEED, Registry


def _key(*parts: str | None) -> str | None:
    return None if any(p is None or p == "" for p in parts) else ":".join((KEY_VERSION, *parts))


def court_id(c: dict, g: Registry = SEED) -> str:
    if c.get("court"):
        return c["court"]["id"]
    rows = g.by_code.get(fold(c["fields"].get("series")), [])
    return rows[0]["id"] if len(rows) == 1 or rows and rows[0]["jurisdiction"].startswith("ca") else fold(c["fields"].get("series"))


def neutral(c: dict, g: Registry) -> str | None:
    f = c["fields"]
    return _key("neutral", year(f.get("year")), court_id(c, g), num(f.get("number")) if f.get("number") else None)


def reporter(c: dict, g: Registry) -> str | None:
    """The year counts where a reporter's volumes are numbered by year, or where an unknown one's year is in brackets."""
    f = c["fields"]
    page, volume = f.get("page") or "", f.get("volume")
    if not page.isdecimal():
        return None
    rows = g.by_reporter.get(fold(f.get("reporter")), [])
    if f.get("reporter_id"):
        rows = [r for r in rows if r["id"] == f["reporter_id"]] or rows
    if not rows:
        bracketed = f.get("bracketed") if f.get("bracketed") is not None else c["span"]["text"].lstrip().startswith("[")
        middle = [f["year"]] if bracketed and f.get("year") else []
        return _key("reporter", "unknown", fold(f.get("reporter")), *middle, *([num(volume)] if volume else []), num(page)) if volume or middle else None
    ways = {r["year_volume"] for r in rows}
    if len(ways) > 1 and not f.get("year"):
        return None
    row = rows[0]
    by_year = row["year_volume"]
    if by_year and not f.get("year") or not by_year and not volume:
        return None
    middle = ([f["year"]] if by_year else []) + ([num(volume)] if volume else [])
    return _key("reporter", row["id"], fold(g.edition(row, f["reporter"])), *middle, num(page))


def database(c: dict) -> str | None:
    f = c["fields"]
    name = re.sub(r"no$", "", fold(f.get("reporter"))) or None
    return _key("database", name, f.get("year"), num(f.get("number")))


def chapter(s: str | None) -> str | None:
    return ident(re.sub(r"^\s*ch?(?:ap)?\.?\s+", "", s or "", flags=re.I))


def series_row(c: dict, g: Registry) -> dict | None:
    rows = g.by_series.get(fold(c["fields"].get("series")), [])
    return rows[0] if len(rows) == 1 else None


def statute(c: dict, g: Registry) -> str | None:
    f, row = c["fields"], series_row(c, g)
    jurisdiction = row["jurisdiction"] if row else c.get("jurisdiction")
    series = row["id"] if row else ident(f.get("series")) or "-"
    return _key("statute", jurisdiction, series, f.get("year") or "-", chapter(f.get("chapter")))


def regulation_parts(series: str | None, number: str | None, stated: str | None) -> tuple[str | None, str | None]:
    """Year and number: 191/11 and 227 of 2002-227; two-digit years up to 50 are of this century."""
    n = re.sub(r"^(?:r|reg|règl)\.?\s+", "", (number or "").strip(), flags=re.I)
    m = re.fullmatch(r"(\w+)/(\d{2}|\d{4})", n)
    if m:
        return year(m[2]), num(m[1])
    m = re.fullmatch(r"(\d{2}|\d{4})-(\w+)", n)
    if m and year(m[1]):
        return year(m[1]), num(m[2])
    return year(stated), num(n) if n else None


def regulation(c: dict, g: Registry) -> str | None:
    f, row = c["fields"], series_row(c, g)
    jurisdiction = row["jurisdiction"] if row else c.get("jurisdiction")
    series = row["id"] if row else ident(f.get("series"))
    if f.get("chapter") and series != "rro":
        extra = num(re.sub(r"^r\.?\s+", "", f["regulation"])) if f.get("regulation") else None
        return _key("regulation", jurisdiction, series, "-", chapter(f["chapter"]) + (f"-r-{extra}" if extra else ""))
    return _key("regulation", jurisdiction, series, *regulation_parts(series, f.get("regulation"), f.get("year")))


def key(c: dict, g: Registry = SEED) -> str | None:
    """The key of a full citation that is not in doubt; none otherwise."""
    if c["form"] != "full":
        return None
    f, kind = c["fields"], c["format"]
    if c["authority"] == "constitution":
        text = f"{(c.get('style') or {}).get('text') or ''} {c['span']['text']}"
        if f.get("part") == "I" or re.search(r"Charter of Rights and Freedoms|Charte canadienne", text):
            return _key("constitution", "ca", "charter")
        m = re.search(r"(?:Constitution Act,|Loi constitutionnelle de) (1867|1982)", text)
        return _key("constitution", "ca", m[1]) if m else None
    if kind == "neutral":
        return neutral(c, g)
    if kind == "reporter":
        return reporter(c, g)
    if kind == "can_lii":
        return _key("canlii", f.get("year"), num(f.get("number")))
    if kind == "database":
        return database(c)
    if kind == "statute_volume":
        return statute(c, g)
    if kind == "regulation_series":
        return regulation(c, g)
    if kind == "code":
        return _key("code", fold(f.get("series")), num(f.get("volume")), ident(f.get("section")))
    if kind == "treaty":
        return _key("treaty", fold(f.get("series")), f.get("volume") or f.get("year"), f.get("page") or f.get("number"))
    if c["authority"] == "journal":
        rows = g.by_journal.get(fold(f.get("reporter")), [])
        return _key("journal", rows[0]["id"] if rows else ident(f.get("reporter")), num(f.get("volume") or f.get("year")), num(f.get("page")))
    return None


def neutral_key(year_: Column, court: Column, number: Column) -> Column:
    """The key of a neutral citation from columns; null where a part is."""
    return F.concat(F.lit(f"{KEY_VERSION}:neutral:"), year_, F.lit(":"), court, F.lit(":"), num_column(number))


def reporter_key(reporter_id: Column, edition: Column, by_year: Column, year_: Column, volume: Column, page: Column) -> Column:
    middle = F.concat(F.when(by_year, F.concat(year_, F.lit(":"))).otherwise(F.lit("")), F.when(volume.isNotNull() & (volume != ""), F.concat(num_column(volume), F.lit(":"))).otherwise(F.lit("")))
    return F.concat(F.lit(f"{KEY_VERSION}:reporter:"), reporter_id, F.lit(":"), fold_column(edition), F.lit(":"), middle, num_column(page))


def statute_key(jurisdiction: Column, series: Column, year_: Column, chapter_: Column) -> Column:
    folded = F.regexp_replace(F.lower(F.regexp_replace(chapter_, r"(?i)^\s*ch?(?:ap)?\.?\s+", "")), r"[^\p{IsAlphabetic}\p{N}.]+", "-")
    return F.concat(F.lit(f"{KEY_VERSION}:statute:"), jurisdiction, F.lit(":"), series, F.lit(":"), F.coalesce(year_, F.lit("-")), F.lit(":"), F.regexp_replace(folded, r"^[-.]+|[-.]+$", ""))


def regulation_key(jurisdiction: Column, series: Column, number: Column) -> Column:
    """Of numbers like 191/11, 2002-227 and 98-123."""
    slash, dash = F.regexp_extract(number, r"^(\w+)/(\d{2,4})$", 2), F.regexp_extract(number, r"^(\d{2,4})-(\w+)$", 1)
    y = F.when(slash != "", slash).otherwise(dash)
    full = F.when(F.length(y) == 4, y).otherwise(F.concat(F.when(F.expr("1 = 1") & (y.cast("int") <= 50), F.lit("20")).otherwise(F.lit("19")), y))
    n = F.when(slash != "", F.regexp_extract(number, r"^(\w+)/(\d{2,4})$", 1)).otherwise(F.regexp_extract(number, r"^(\d{2,4})-(\w+)$", 2))
    return F.concat(F.lit(f"{KEY_VERSION}:regulation:"), jurisdiction, F.lit(":"), series, F.lit(":"), full, F.lit(":"), num_column(n))
