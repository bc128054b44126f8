"""Readings of citations: candidates from the registry, ranked, and chosen only if one is best."""

from __future__ import annotations

import re

from ..functions.text import fold, is_year
from ..sources.registry import FRENCH_CODES, Registry

#: Parts of a score, in order; the least is best.
SCORE = ("jurisdiction", "year_form", "outside_years", "variant")


def priority(jurisdiction: str, order: list[str]) -> int:
    """The place of the first entry of the order that holds the jurisdiction."""
    return next((i for i, p in enumerate(order) if jurisdiction == p or jurisdiction.startswith(p + "-")), len(order))


def listed(jurisdiction: str, allowed: list[str] | None) -> bool:
    return allowed is None or any(jurisdiction == a or jurisdiction.startswith(a + "-") for a in allowed)


def select(kind: str, candidates: list[tuple[dict, tuple]]) -> tuple[dict | None, list[dict]]:
    """The one candidate of least score, or none where several have it; every candidate as an interpretation."""
    if not candidates:
        return None, []
    least = min(s for _, s in candidates)
    best = [r for r, s in candidates if s == least]
    chosen = best[0] if len(best) == 1 else None
    reason = lambda r, s: "selected" if r is chosen else "ambiguous_registry" if s == least else "lower_ranked"
    return chosen, [{"kind": kind, "id": r["id"], "canonical": r.get("abbreviation") or r.get("name") or r["id"], "jurisdiction": r["jurisdiction"], "selected": r is chosen, "reason": reason(r, s)} for r, s in candidates]


#: Courts of codes by registry, code, brackets and options; the registry is held so that its identity stays its own.
_COURTS: dict[tuple, tuple[Registry, dict | None, list[dict]]] = {}


def court_of_code(g: Registry, code: str, bracketed: bool, o) -> tuple[dict | None, list[dict]]:
    """Brackets around the year speak for a court outside Canada, none for a Canadian one."""
    asked = id(g), code, bracketed, o.jurisdictions and tuple(o.jurisdictions), tuple(o.jurisdiction_priority)
    if asked not in _COURTS:
        if len(_COURTS) >= 10_000:
            _COURTS.clear()
        _COURTS[asked] = g, *_court_of_code(g, code, bracketed, o)
    _, court, readings = _COURTS[asked]
    return court, [{**r} for r in readings]


def _court_of_code(g: Registry, code: str, bracketed: bool, o) -> tuple[dict | None, list[dict]]:
    rows = [r for r in g.by_code.get(fold(code), []) if listed(r["jurisdiction"], o.jurisdictions)]
    return select("court", [(r, (bracketed == r["jurisdiction"].startswith("ca"), priority(r["jurisdiction"], o.jurisdiction_priority))) for r in rows])


def court_of_text(g: Registry, text: str) -> dict | None:
    """The court that a parenthetical names, with or without a date after it."""
    t = re.sub(r",?\s*(?:\d{1,2}\s+)?(?:(?:Jan|Feb|Mar|Apr|May|June?|July?|Aug|Sept?|Oct|Nov|Dec|Févr|Avr|Mai|Août|Déc)\w*\.?\s+)?(?:\d{1,2},\s*)?(?:1[6-9]|20|21)\d{2}$", "", text).strip()
    rows = g.by_court.get(fold(t), []) if t else []
    return rows[0] if len(rows) == 1 else None


def reporter_of(g: Registry, written: str, year: str | None, bracketed: bool, o) -> tuple[dict | None, list[dict]]:
    rows = [r for r in g.by_reporter.get(fold(written), []) if listed(r["jurisdiction"], o.jurisdictions)]

    def score(r: dict) -> tuple:
        outside = bool(r["years"]) and is_year(year, 9999) and not r["years"][0] <= int(year) <= r["years"][1]
        return priority(r["jurisdiction"], o.jurisdiction_priority), bool(year) and bracketed != r["year_volume"], outside, written not in r["editions"]

    scored = [(r, score(r)) for r in rows]
    if o.year_runs:  # years rule out, even where nothing else is left
        scored = [(r, s) for r, s in scored if not s[2]]
    if any(not s[2] for _, s in scored):  # evidence of the year goes before the setting
        scored = [(r, s) for r, s in scored if not s[2]]
    return select("reporter", scored)


def series_of(g: Registry, written: str, o) -> tuple[dict | None, list[dict]]:
    rows = [r for r in g.by_series.get(fold(written), []) if listed(r["jurisdiction"], o.jurisdictions)]
    return select("series", [(r, (priority(r["jurisdiction"], o.jurisdiction_priority),)) for r in rows])


def two_digit_year(text: str, first: int, last: int) -> str | None:
    """The year between two bounds that two digits can mean, if it is only one."""
    found = [c * 100 + int(text) for c in range(16, 22) if first <= c * 100 + int(text) <= last]
    return str(found[0]) if len(found) == 1 else None


def instrument(title: str | None) -> str | None:
    """The kind of instrument that a title names."""
    t = title or ""
    if re.search(r"\bConstitution Act\b|Loi constitutionnelle|Charter of Rights and Freedoms|Charte canadienne", t):
        return "constitution"
    if re.search(r"\bRules?\b|Règles", t) and not re.search(r"\bAct\b", t):
        return "court_rule"
    if re.search(r"^(?:Convention|Treaty|Traité|Agreement between)\b", t):
        return "treaty"
    if re.search(r"\bRegulations?\b|Règlement", t):
        return "regulation"
    return None


def classify(c: dict, family: str, m: re.Match, g: Registry, o) -> bool:
    """Fill a citation's authority, format, fields, court and jurisdiction from its family's groups; False if it is none."""
    v = {k: x for k, x in m.groupdict().items() if x is not None}
    get = lambda *names: next((v[n] for n in names if n in v), None)
    f = c["fields"]
    bracketed = "bracketed" in v
    year = get("year", "year2", "bracketed", "paren")
    if year and not is_year(year, o.latest_year):
        return False
    f["year"] = year
    if family in ("neutral", "numberless"):
        code = " ".join(v["series"].split()) if not v["series"].isalpha() else v["series"]
        if fold(code) not in g.by_code and (fold(code) in g.by_reporter or fold(code) in g.by_series or code in ("CRC", "UNTS", "LEXIS") or bracketed):
            return False
        court, readings = court_of_code(g, code, bracketed, o)
        if fold(code) in g.by_code and not readings:
            return False
        # a code that reporters share is a report where a page follows a year's volume
        if bracketed and not readings and fold(code) in g.by_reporter:
            return False
        c |= {"authority": "case", "format": "neutral" if family == "neutral" else "numberless"}
        f |= {"series": code, "number": v.get("number")}
        c["interpretations"] += readings
        if court:
            c |= {"court": {"id": court["id"], "text": code}, "jurisdiction": court["jurisdiction"]}
            if code in FRENCH_CODES:
                c["language"] = "fr"
    elif family == "canlii":
        c |= {"authority": "case", "format": "can_lii"}
        f["number"] = v["number"]
    elif family == "database":
        c |= {"authority": "case", "format": "database"}
        f |= {"reporter": re.sub(r"\s+", " ", v["reporter"]), "number": v["number"]}
    elif family in ("reporter", "unknown_reporter", "law_reports", "short"):
        written = f"LR {v['division']}" if family == "law_reports" else re.sub(r"\s+", " ", v["reporter"])
        if family == "reporter" and not (bracketed or v.get("volume")):
            return False
        chosen, readings = reporter_of(g, written, year, bracketed, o)
        if not readings and (family != "unknown_reporter" or fold(written) in g.by_reporter):
            return False
        c |= {"authority": "case", "format": "reporter"}
        f |= {"volume": v.get("volume"), "reporter": written, "page": v["page"], "bracketed": bracketed}
        if chosen and chosen["years"] and not year and len(f["volume"] or "") == 2 and not chosen["year_volume"] and chosen["id"] == "dtc":
            f["year"] = two_digit_year(f["volume"], *chosen["years"])
        c["interpretations"] += readings
        if chosen:
            f["reporter_canonical"] = g.edition(chosen, written)
            f["reporter_id"] = chosen["id"]
            c["jurisdiction"] = chosen["jurisdiction"]
            if chosen["court"]:
                c["court"] = {"id": chosen["court"], "text": written}
            if fold(written) in ("rcs", "rcf"):
                c["language"] = "fr"
        if family == "short":
            c["form"] = "short"
    elif family == "journal":
        name = get("journal", "journal2", "journal3")
        rows = g.by_journal.get(fold(name), [])
        if not rows and fold(name) in g.by_reporter:
            return False
        c |= {"authority": "journal", "format": "publication"}
        f |= {"volume": get("volume", "volume2", "volume3"), "issue": get("issue", "issue2"), "reporter": name, "page": get("page", "page2", "page3")}
        if len(rows) == 1:
            f["journal_id"] = rows[0]["id"]
            c["jurisdiction"] = rows[0]["jurisdiction"]
    elif family == "code":
        series = re.sub(r"\s+", "", v["series"])
        usc = fold(series).startswith("usc")
        c |= {"authority": "statute" if usc else "regulation", "format": "code", "jurisdiction": "us"}
        f |= {"volume": v["volume"], "series": series, "section": v["section"]}
    elif family in ("statute", "regulation_qc", "regulation_crc", "regulation_rro", "regulation"):
        chosen, readings = series_of(g, v["series"], o)
        if not readings:
            return False
        statute = family == "statute"
        c |= {"authority": "statute" if statute else "regulation", "format": "statute_volume" if statute else "regulation_series"}
        f |= {"series": re.sub(r"\s+", " ", v["series"]), "chapter": v.get("chapter"), "regulation": v.get("regulation"), "schedule": v.get("schedule")}
        c["interpretations"] += readings
        if chosen:
            f["series_id"] = chosen["id"]
            c["jurisdiction"] = chosen["jurisdiction"]
            if any(fold(x) == fold(v["series"]) for x in chosen["french"]) and fold(v["series"]) != fold(chosen["abbreviation"]):
                c["language"] = "fr"
    elif family in ("regnal", "uk_act"):
        c |= {"authority": "statute", "format": "statute_volume", "jurisdiction": "uk"}
        f |= {"regnal": v.get("regnal"), "chapter": v["chapter"], "title": v.get("title")}
    elif family in ("charter", "constitution"):
        c |= {"authority": "constitution", "format": "constitution", "jurisdiction": "ca"}
        f["part"] = "I" if family == "charter" else None
        if m[0].startswith(("partie", "Loi")):
            c["language"] = "fr"
    elif family == "treaty":
        c |= {"authority": "treaty", "format": "treaty", "jurisdiction": "int"}
        f |= {"series": get("series", "series2"), "volume": v.get("volume"), "page": v.get("page"), "number": v.get("number")}
    elif family == "bill":
        c |= {"authority": "bill", "format": "parliamentary", "jurisdiction": "ca"}
        f["bill"] = v["bill"]
    elif family == "debate":
        c |= {"authority": "debate", "format": "parliamentary", "jurisdiction": "ca" if "body" in v else "uk"}
        f |= {"session": v.get("session"), "volume": v.get("volume")}
    elif family == "paper":
        c |= {"authority": "parliamentary_paper", "format": "parliamentary", "jurisdiction": "uk"}
        f |= {"series": v["series"], "number": v["number"]}
    elif family == "book":
        c |= {"authority": "book", "format": "publication"}
        f |= {"edition": v.get("edition"), "place": v["place"], "publisher": v["publisher"], "page": v.get("page")}
    elif family == "url":
        c |= {"authority": "webpage", "format": "url"}
        f["url"] = get("url", "url2")
    if f.get("year"):
        f["year_number"] = int(f["year"])
    c["reasons"].append(family)
    return True


def is_ambiguous(c: dict) -> bool:
    """Whether some kind has readings of which none was chosen."""
    kinds = {i["kind"] for i in c["interpretations"]}
    return any(not any(i["selected"] for i in c["interpretations"] if i["kind"] == k) for k in kinds)
