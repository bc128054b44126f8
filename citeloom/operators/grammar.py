"""Patterns of citation families, built from a registry."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from ..functions.text import fold
from ..sources.registry import SEED, Registry

YEAR = r"(?:1[6-9]|20|21)\d{2}"
LEFT = r"(?<![\w.\-/])"
#: Where a year begins, or the bracket before it: the only places where a core of the families BY_YEAR may.
YEAR_AT = re.compile(r"\[(?=(?:1[6-9]|2[01])\d\d)|1(?=[6-9]\d\d)|2(?=[01]\d\d)")
BY_YEAR = frozenset(("neutral", "numberless", "canlii", "database"))
CHAPTER = r"(?:[A-Z]{2,}-\d{4}|[A-Z]*[-.]?\d+(?:[.\-]?\w+)*(?:\s\(\d\w{1,2}\sSupp\.?\))?)"
VALUE = r"(?:\d+(?:\.\d+)*[a-z]?(?:\([\w.]+\))*(?![\w(])|[ivxlc]+\b)"
RANGE = rf"{VALUE}(?:\s*(?:[-–—]|to\b|à\b)\s*(?:{VALUE}|(?:\([\w.]+\))+))?"
LIST = rf"{RANGE}(?:(?:\s*,\s*|\s*,?\s+(?:and|et|&)\s+|\s*;\s*(?=\d+\s*(?:\[|[.;]|$)))(?!{YEAR}\s+[A-Z\[]){RANGE}(?!\s+[A-Z]))*"
#: The men by whose names the first volumes of the United States Reports went.
NOMINATIVE = r"(?:Dall|Cranch|Wheat|Pet|How|Black|Wall)\.?"
#: Words that name a kind of pinpoint, longest first.
PIN_WORDS = (
    ("paragraph", r"paragraphes?|paragraphs?|paras?\.?|pars?\.?|¶+"), ("subsection", r"subsections?|sub-?ss?\."), ("page", r"pages?|pp?\.?"), ("section", r"sections?|ss?\.?|§§?"),
    ("article", r"articles?|arts?\.?"), ("rule", r"rules?|rr?\.?"), ("schedule", r"schedules?|sched\.?|sch\.?"), ("footnote", r"footnotes?|nn?\.?"), ("clause", r"clauses?|cls?\.?"),
)
AT = r"(?:at|aux?|à\s+l['’]|à\s+la|à)\s*"
PINPOINT = re.compile(rf"(?P<lead>\s*,?\s*(?:{AT})?)(?:" + "|".join(rf"(?P<{k}>(?<![\w.])(?:{w}))(?![^\W\d])" for k, w in PIN_WORDS) + rf")\s*(?P<values>{LIST})")
BARE_PAGE = re.compile(rf"(?P<lead>\s*,?\s*(?:at|à)\s+)(?P<values>{LIST})")
REPORT_PAGE = re.compile(rf"(?P<lead>\s*,\s*)(?P<values>\d+(?:[-–]\d+)?(?:,\s\d+(?:[-–]\d+)?(?![\w\s]*\d))*)(?=\s*(?:\(|[.;,]|$))(?!,\s*\d+\s+[A-Z])")
BRACKETED = re.compile(r"(?P<lead>\s*(?:at\s+)?)\[(?P<first>\d+)\](?:\s*[-–—]\s*\[(?P<last>\d+)\])?")
SIGNALS = r"see\s+also|see\s+generally|see,?\s+e\.?g\.?|but\s+see|see|cf\.?|contra|e\.g\.|compare|comparer|accord|voir\s+aussi|voir|mais\s+voir"
SIGNAL = re.compile(rf"(?:^|(?<=[.;:!?)\]\n]))\s*(?P<signal>{SIGNALS}),?\s+(?=\S)", re.I)
BACK = re.compile(
    r"(?<![\w])(?P<ibid>[Ii]bid(?:em)?\b\.?|IBID\b|[Ii]d\.(?=\s|,|$))|(?P<supra>\b[Ss]upra\b(?:,?\s*(?:foot)?n(?:ote)?s?\.?\s*(?P<n1>\d+))?|\babove\s+n\.?\s*(?P<n2>\d+)|\(n\s*(?P<n3>\d+)\)|\bprécitée?s?\b(?:,?\s*note\s*(?P<n4>\d+))?|\bop\.?\s?cit\.?(?:,?\s*(?:foot)?note\s*(?P<n5>\d+))?)"
)
#: A character that a back reference may begin with, before what has to follow: a quick look for places where BACK is tried.
BACK_AT = re.compile(r"[IiSsapo(](?=bid|BID|d\.|upra|bove|n\s*\d|récit|p\.?\s?cit)")
SECTION_SIGN = re.compile(r"§§?\s*(?P<section>\d(?:[\w.()-]*[\w)])?)")
NAME_BEFORE = re.compile(r"(?P<name>[A-ZÀ-Þ][\w'’.&-]*(?:\s+(?:v\.?|c\.?|and|of|the|de|du|transcript|[A-ZÀ-Þ(][\w'’.&)-]*))*)\s*,?\s*$")
#: Characters that stand in no name before a reference.
NOT_IN_NAMES = "|;:,\"“”?!/[]{}<>"
SHORT_FORM = re.compile(r"\s*\[(?P<name>[^\[\]\n\t]{1,80})\]|\s*\((?:the\s+)?[\"“](?P<quoted>[^\"”]{1,80})[\"”]\)")
NOT_SHORT = re.compile(r"^\d+$|emphasis|footnotes? omitted|citations? omitted|translat|italics|traduction|\bTAB\b|unreported|non publié", re.I)
#: Phrases of later history and the relation each states.
HISTORY = (
    (r"leave to appeal(?: to [^,;.]{1,30}?)? refused|autorisation d['’]appel(?: à [^,;.]{1,30}?)? refusée|leave to appeal(?: to [^,;.]{1,30}?)? denied", "leave_refused"),
    (r"leave to appeal(?: to [^,;.]{1,30}?)? granted|autorisation d['’]appel(?: à [^,;.]{1,30}?)? accordée", "leave_granted"),
    (r"appeal dismissed|appel rejeté", "appeal_dismissed"), (r"appeal allowed|appel accueilli", "appeal_allowed"),
    (r"aff['’]g|affirming|confirmant|conf['’]g", "affirming"), (r"rev['’]g|reversing|infirmant|inf['’]g", "reversing"), (r"aff['’]d(?: by)?|affirmed(?: by)?|conf(?:irmé)? par", "affirmed"),
    (r"rev['’]d(?: by)?|reversed(?: by)?|inf(?:irmé)? par", "reversed"), (r"var['’]g|varying", "varying"), (r"var['’]d(?: by)?|varied(?: by)?", "varied"), (r"overruled by|overruled", "overruled"),
    (r"cert\.? denied", "cert_denied"), (r"citing|citant", "citing"), (r"quoting", "quoting"),
)
RELATION = re.compile("|".join(f"(?P<r{i}>{p})" for i, (p, _) in enumerate(HISTORY)), re.I)
TITLE_WORD = re.compile(r"\b(?:Act|Code|Charter|Charte|Loi|Regulations?|Règlement|Rules|Règles|Constitution|Ordinance|Order|Statute|Convention|Agreement|Treaty|Traité|Accord)\b")


def name_before(text: str) -> re.Match | None:
    """The name that a text ends with; places are those in the text."""
    last = text.rstrip()
    last = last[:-1] if last.endswith(",") else last
    return NAME_BEFORE.search(text, max([last.rfind(c) for c in NOT_IN_NAMES]) + 1)


def backs(text: str, start: int = 0, end: int | None = None) -> Iterator[re.Match]:
    """The matches of BACK between two places, in order."""
    end, at = len(text) if end is None else end, start
    for h in BACK_AT.finditer(text, start, end):
        if h.start() >= at and (m := BACK.match(text, h.start(), end)):
            yield m
            at = m.end()


def spellings(names: list[str]) -> set[str]:
    """Names, and abbreviations of capitals also with points."""
    out = set()
    for n in names:
        out.add(n)
        head, _, tail = n.partition(" ")
        if head.isupper() and head.isalpha() and 1 < len(head) <= 6:
            out.add("".join(f"{c}." for c in head) + (f" {tail}" if tail else ""))
    return out


def spelled(names: list[str]) -> str:
    """An alternation of spellings, by first characters, longest first; spaces may vary."""
    out = spellings(names)
    pattern = lambda x: re.escape(x).replace(r"\ ", r"\s+").replace("'", "['’]")
    by: dict[str, list[str]] = {}
    for x in sorted(out, key=lambda x: (-len(x), x)):
        by.setdefault(x[0], []).append(pattern(x[1:]))
    return "|".join(f"{pattern(c)}(?:{'|'.join(rest)})" for c, rest in by.items())


def firsts(names: list[str]) -> str:
    """The characters that names begin with, as the inside of a set."""
    return "".join(re.escape(c) for c in sorted({n[0] for n in names}))


#: A word, with the point after it: what the names of reports and journals begin with stands so in a text that cites one.
WORD = re.compile(r"[^\W\d_]+\.?")


@lru_cache(maxsize=8)
def _beginnings(key: int) -> dict[str, frozenset[str]]:
    g = _REGISTRIES[key]
    reports = [x for r in g.reporters for x in (*r["editions"], *r["variations"])]
    names = {"reporter": reports, "short": reports, "journal": [x for r in g.journals for x in (r["abbreviation"], *r["variations"])]}
    found = {f: [WORD.match(x) for x in spellings(n)] for f, n in names.items()}
    return {f: frozenset(m[0] for m in ms) for f, ms in found.items() if all(ms)}


def beginnings(registry: Registry = SEED) -> dict[str, frozenset[str]]:
    """Of families whose cores hold a name of the registry the words that these names begin with."""
    _REGISTRIES[id(registry)] = registry
    return _beginnings(id(registry))


@lru_cache(maxsize=8)
def _families(key: int) -> list[tuple[str, re.Pattern]]:
    g = _REGISTRIES[key]
    codes = spelled([c for r in g.courts for c in r["neutral"]])
    report_names = [x for r in g.reporters for x in (*r["editions"], *r["variations"])]
    reports = spelled(report_names)
    us = spelled([x for r in g.reporters if r["jurisdiction"].startswith("us") for x in (*r["editions"], *r["variations"])])
    statute_names = [x for r in g.series if "statutes" in r["kind"] for x in (r["abbreviation"], *r["variations"], *r["french"])]
    statutes = spelled(statute_names)
    regulation_names = [x for r in g.series if r["kind"] == "regulations" for x in (r["abbreviation"], *r["variations"], *r["french"])]
    regulations = spelled(regulation_names)
    journals = spelled([x for r in g.journals for x in (r["abbreviation"], *r["variations"])])
    words = r"[A-Z][\w.'’&]*(?:\s(?:of|and|de|et|the|&|[A-Z][\w.'’&]*))*"
    source = {
        "neutral": rf"(?=[\[12]){LEFT}(?:\[(?P<bracketed>{YEAR})\]|(?P<year>{YEAR}))\s+(?P<series>{codes}|[A-Z]{{3,9}})\s+(?P<number>\d{{1,9}}[a-z]?)(?![\w(])",
        "numberless": rf"(?=[12]){LEFT}(?P<year>{YEAR})\s+(?P<series>{codes})(?=\s+at\s+para|\s+\(unreported\))",
        "canlii": rf"{LEFT}(?P<year>{YEAR})\s+CanLII\s+(?P<number>\d+)(?:\s+\(CanLII\))?",
        "database": rf"(?=[\[12]){LEFT}\[?(?P<year>{YEAR})\]?\s+(?P<reporter>Carswell[A-Z]\w*|[A-Z]{{1,3}}\.?J\.?\s+No\.?|WLR?\b|U\.?S\.?\s+LEXIS|LEXIS|J\.?Q\.?\s+no\.?)\s+(?P<number>\d+)\b",
        "law_reports": r"(?:\((?P<paren>" + YEAR + r")\),?\s+)?\bLR\s+(?P<volume>\d+)\s+(?P<division>HL|QB|CP|Ex|Ch|Eq)\s+(?P<page>\d+)",
        "journal": rf"(?=[(\d])(?:\((?P<year>{YEAR})\)\s+(?P<volume>\d+)(?::(?P<issue>[\d-]+))?\s+(?P<journal>{journals})\s+(?P<page>\d+)|(?<=[\"”]\s)\((?P<year2>{YEAR})\)\s+(?P<volume2>\d+)(?::(?P<issue2>[\d-]+))?\s+(?P<journal2>{words})\s+(?P<page2>\d+)|{LEFT}(?P<volume3>\d+)\s+(?P<journal3>{journals})\s+(?P<page3>\d+))",
        "reporter": rf"(?=[\d\[({firsts(report_names)}])(?:\[(?P<bracketed>{YEAR})\]\s*|\((?P<paren>{YEAR})\),?\s*)?{LEFT}(?:(?P<volume>\d{{1,4}})\s+)?(?P<reporter>{reports})(?:\s+\(\d+\s+{NOMINATIVE}\))?\s+(?P<page>\d{{1,6}}(?![\w])|_{{2,}}|[ivxlc]{{2,}}\b)",
        "unknown_reporter": rf"(?:\[(?P<bracketed>{YEAR})\]|\((?P<paren>{YEAR})\),)\s*(?P<volume>\d+)\s+(?P<reporter>[A-Z][A-Z.]{{1,8}}(?:\s\(\d\w{{1,2}}\))?)\s+(?P<page>\d+)\b",
        "short": rf"(?=\d){LEFT}(?P<volume>\d{{1,4}})\s+(?P<reporter>{us}),?\s+at\s+(?P<page>\d+)",
        "code": rf"{LEFT}(?P<volume>\d+)\s+(?P<series>U\.?\s?S\.?\s?C\.?(?:\s?A\.?)?|C\.?\s?F\.?\s?R\.?)\s*(?:§§?|s(?:ec)?\.)\s*(?P<section>\d[\w.()-]*[\w)]|\d)",
        "regulation_qc": rf"{LEFT}(?P<series>RLRQ|CQLR|LRQ)\s*,?\s+ch?\.?\s*(?P<chapter>{CHAPTER}),\s*r\.?\s*(?P<regulation>[\d.]+\d|\d)",
        "statute": rf"(?=[{firsts(statute_names)}]){LEFT}(?P<series>{statutes})\s*,?\s*(?:(?P<year>{YEAR})\s*,?\s*)?(?:c|ch|chap)\b\.?\s*(?P<chapter>{CHAPTER})(?:,\s*Sch(?:ed(?:ule)?)?\.?\s+(?P<schedule>\w+))?",
        "regulation_crc": rf"{LEFT}(?P<series>CRC|C\.R\.C\.)\s*,?\s*(?:(?P<year>{YEAR})\s*,?\s*)?ch?\.?\s*(?P<chapter>\d+)",
        "regulation_rro": rf"{LEFT}(?P<series>RRO|R\.R\.O\.)\s*(?P<year>{YEAR})\s*,?\s*(?:Reg|Règl)\.?\s*(?P<regulation>\d+)",
        "regulation": rf"(?=[{firsts(regulation_names)}]){LEFT}(?P<series>{regulations})\s*[/]?\s*(?P<regulation>(?:EC)?(?:\d{{1,4}}[-/]\d+|\d+[-/]\d{{1,4}}))(?![\w-])",
        "regnal": r"(?P<regnal>\d+(?:\s&\s\d+)?\s(?:Vict|Geo\s[IV]+|Will\s[IV]+|Eliz\sII|Edw\sVII)),?\sc\s(?P<chapter>\d+)",
        "uk_act": rf"(?P<title>(?:[A-Z][\w'’]*\s)(?:(?:[A-Z][\w'’]*|of|and|the)\s)*Act\s(?P<year>{YEAR}))\s\((?:UK|R-?U)\),\sc\s(?P<chapter>\d+)",
        "charter": r"Part I of the Constitution Act, 1982(?:, being Schedule B to the Canada Act 1982 \(UK\), 1982, c 11)?|partie I de la Loi constitutionnelle de 1982(?:, constituant l['’]annexe B de la Loi de 1982 sur le Canada \(R-U\), 1982, c 11)?",
        "constitution": r"Constitution Act, (?P<year>1867|1982)(?!\s\(UK\))|Loi constitutionnelle de (?P<year2>1867|1982)(?!\s\(R-U\))",
        "treaty": rf"{LEFT}(?P<volume>\d+)\s+(?P<series>UNTS|ETS|ILM)\s+(?P<page>\d+)|\b(?P<series2>Can TS|RT Can|UKTS)\s+(?P<year>{YEAR})\s+[Nn]o\.?\s+(?P<number>\d+)",
        "bill": r"\bBill\s+(?P<bill>[CS]-\d+)\b",
        "debate": r"\b(?P<body>House of Commons Debates|Debates of the Senate|Débats de la Chambre des communes),\s+(?P<session>\d+-\d+)(?:,\s[Nn]o\.?\s\d+)?\s+\([^)]*\)|\bH[CL] Deb(?:ates)?\s+(?P<date>\d+\s\w+\s\d{4}),?\s+vol\s+(?P<volume>\d+)",
        "paper": r"\b(?P<series>Cmnd|Cmd|Cm)\s+(?P<number>\d+)\b",
        "book": rf"(?:(?P<edition>\d+(?:st|nd|rd|th|e))\s+(?:ed|éd)\.?\s+)?\((?P<place>[A-ZÀ-Þ][\w .,'’-]+):\s(?P<publisher>[^():]+),\s(?P<year>{YEAR})\)(?:\s(?P<page>\d+)(?![\w]))?",
        "url": r"online:?\s*<(?P<url>[^<>\s]+)>|(?P<url2>https?://[^\s<>\"]*[^\s<>\".,;:)])",
    }
    return [(k, re.compile(v)) for k, v in source.items()]


_REGISTRIES: dict[int, Registry] = {}


def families(registry: Registry = SEED) -> list[tuple[str, re.Pattern]]:
    """(family, pattern) in the order of precedence for hits of one extent."""
    _REGISTRIES[id(registry)] = registry
    return _families(id(registry))


def is_reporter(registry: Registry, name: str) -> bool:
    return fold(name) in registry.by_reporter
