"""Addresses of cited sources, and of places in them."""

from __future__ import annotations

import re
from urllib.parse import quote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold, num, year
from ..sources.registry import CANLII_CODE, FRENCH_CODES, SEED, Registry
from .keys import chapter, regulation_parts, series_row

CANLII = "https://www.canlii.org"


def encode_component(s: str) -> str:
    return quote(s, safe="-_.!~*'()")


def encode_column(c: Column) -> Column:
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canlii_case(c: dict, language: str = "en", g: Registry = SEED) -> str | None:
    """A decision's page, where its court has a route and its code is one that CanLII numbers by."""
    f = c["fields"]
    if c["form"] != "full" or not f.get("year") or not (f.get("number") or "").isdecimal():
        return None
    number = num(f["number"])
    if c["format"] == "can_lii":
        row = g.court_ids.get((c.get("court") or {}).get("id"))
        if not row or not row["canlii"]:
            return None
        slug = f"{f['year']}canlii{number}"
        return f"{CANLII}/{language}/{row['canlii']}/doc/{f['year']}/{slug}/{slug}.html"
    code = f.get("series") or ""
    rows = [r for r in g.by_code.get(fold(code), []) if r["canlii"]]
    if c["format"] != "neutral" or " " in code or len(rows) != 1 or not rows[0]["jurisdiction"].startswith("ca"):
        return None
    row, written = rows[0], fold(code)
    french = code in FRENCH_CODES
    if code in CANLII_CODE:
        written, french = CANLII_CODE[code], False
    elif not french and language == "fr" and row["canlii_fr"] and row["canlii_fr"].rpartition("/")[2].islower():
        written = row["canlii_fr"].rpartition("/")[2]
    lang = "fr" if french or (language == "fr") else "en"
    route = row["canlii_fr"] if lang == "fr" and row["canlii_fr"] and (french or row["canlii_fr"].rpartition("/")[2].islower()) else row["canlii"]
    slug = f"{f['year']}{written}{number}"
    return f"{CANLII}/{lang}/{route}/doc/{f['year']}/{slug}/{slug}.html"


def canlii_year(y: str, style: str | None) -> str:
    """A year in a regulation's number as CanLII writes it; two digits up to 30 are of this century."""
    whole = year(y, 30) or y
    return whole[2:] if style == "two" else whole if style == "four" else y


def slug(s: str) -> str:
    return re.sub(r"-+", "-", re.sub(r"[^\w.]+", "-", s.lower())).strip("-")


def legislation_id(c: dict, g: Registry = SEED) -> tuple[str, str, str] | None:
    """Jurisdiction, folder and id of an enactment."""
    f, row = c["fields"], series_row(c, g)
    if not row or not row["canlii"]:
        return None
    where, database = row["canlii"].split("/")
    folder = {"s": "stat", "a": "astat", "r": "regu"}.get(database[-1], "stat")
    base = slug(row["abbreviation"])
    if row["kind"] == "regulations":
        folder = "regu"
        if f.get("chapter"):
            return where, folder, f"{base}-c-{slug(chapter(f['chapter']))}"
        n = re.sub(r"^(?:r|reg)\.?\s+", "", f.get("regulation") or "", flags=re.I)
        if row["id"] == "rro":
            return where, folder, f"{base}-{f.get('year') or '1990'}-reg-{n}"
        m = re.fullmatch(r"(\w+)/(\d{2,4})", n)
        if m:
            return where, folder, f"{base}-{m[1].lower()}-{canlii_year(m[2], row['canlii_year'])}"
        if not re.fullmatch(r"\d{2,4}-\d+", n):
            y, k = regulation_parts(None, n, f.get("year"))
            n = f"{y}-{k}" if y and k else ""
        return (where, folder, f"{base}-{slug(n)}") if n else None
    if not f.get("chapter"):
        return None
    ch = slug(chapter(f["chapter"]))
    if row["id"] == "rso":
        ch = ch.replace(".", "")
    parts = [base, f.get("year"), "c", ch] if f.get("year") else [base, "c", ch]
    if f.get("schedule"):
        parts += ["sch", slug(f["schedule"])]
    if f.get("regulation"):
        return where, "regu", "-".join([*parts, "r", slug(f["regulation"])])
    return where, folder, "-".join(parts)


def canlii_legislation(c: dict, language: str = "en", g: Registry = SEED) -> str | None:
    got = legislation_id(c, g)
    if not got or "--" in got[2]:
        return None
    where, folder, id_ = got
    return f"{CANLII}/en/{where}/laws/{folder}/{id_}/latest/{id_}.html"


def justice_laws(c: dict, language: str = "en", g: Registry = SEED) -> str | None:
    """A federal enactment's page; none for annual statutes and supplements, whose ids can't be worked out."""
    f, row = c["fields"], series_row(c, g)
    base = f"https://laws-lois.justice.gc.ca/{'fra' if language == 'fr' else 'eng'}"
    if not row:
        return None
    if row["id"] == "rsc" and f.get("year") == "1985" and not re.search(r"supp", f.get("chapter") or "", re.I):
        ch = re.sub(r"^\s*ch?\.?\s+", "", f["chapter"], flags=re.I)
        return f"{base}/{'lois' if language == 'fr' else 'acts'}/{ch}/"
    names = {"sor": ("SOR", "DORS"), "si": ("SI", "TR")}
    folder = "reglements" if language == "fr" else "regulations"
    if row["id"] in names:
        n = f.get("regulation") or ""
        n = n if re.fullmatch(r"\d{2,4}-\d+", n) else f"{f.get('year')}-{n}" if f.get("year") and n else None
        return f"{base}/{folder}/{names[row['id']][language == 'fr']}-{n}/" if n else None
    if row["id"] == "crc":
        ch = chapter(f.get("chapter"))
        return f"{base}/{folder}/C.R.C.,_{'ch' if language == 'fr' else 'c'}._{ch}/" if ch else None
    return None


def legislation_gov_uk(c: dict) -> str | None:
    f = c["fields"]
    if c.get("jurisdiction") != "uk" or not (f.get("chapter") or "").isdecimal() or f.get("series"):
        return None
    if f.get("regnal"):
        m = re.fullmatch(r"(\d+)(?:\s&\s(\d+))?\s(Vict|Geo|Will|Edw|Eliz)\s?([IV]*)", f["regnal"])
        if not m:
            return None
        number = {"": "", "I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7"}[m[4]]
        years = f"{m[1]}-{m[2]}" if m[2] else m[1]
        return f"https://www.legislation.gov.uk/ukpga/{m[3]}{number}/{years}/{f['chapter']}"
    return f"https://www.legislation.gov.uk/ukpga/{f['year']}/{f['chapter']}" if f.get("year") and int(f["year"]) >= 1963 else None


#: Courts of the national archives' service, by folded code, and divisions that have to be stated.
UK_COURTS = {"uksc": "uksc", "ukpc": "ukpc", "ewcaciv": "ewca/civ", "ewcacrim": "ewca/crim"}
UK_DIVISIONS = {"Ch": "ch", "QB": "qb", "KB": "kb", "Admin": "admin", "Comm": "comm", "Fam": "fam", "TCC": "tcc", "Pat": "pat"}


def uk_caselaw(c: dict) -> str | None:
    f = c["fields"]
    code, base = fold(f.get("series")), "https://caselaw.nationalarchives.gov.uk"
    if c["format"] != "neutral" or not (f.get("number") or "").isdecimal() or not f.get("year"):
        return None
    if code in UK_COURTS:
        return f"{base}/{UK_COURTS[code]}/{f['year']}/{num(f['number'])}"
    if code == "ewhc":
        m = re.search(r"EWHC\s+\d+\s+\((\w+)\)", c["full_span"]["text"])
        if m and m[1] in UK_DIVISIONS:
            return f"{base}/ewhc/{UK_DIVISIONS[m[1]]}/{f['year']}/{num(f['number'])}"
    return None


def courtlistener(c: dict, g: Registry = SEED) -> str | None:
    f = c["fields"]
    rows = [r for r in g.by_reporter.get(fold(f.get("reporter")), []) if r["jurisdiction"] == "us"]
    if c["format"] != "reporter" or len(rows) != 1 or not (f.get("page") or "").isdecimal() or not f.get("volume"):
        return None
    return f"https://www.courtlistener.com/c/{encode_component(g.edition(rows[0], f['reporter']))}/{f['volume']}/{f['page']}/"


def url(c: dict, language: str = "en", g: Registry = SEED) -> str | None:
    """The best address of a citation: what it states, else by its format; none where unsure."""
    if c["fields"].get("url"):
        return c["fields"]["url"]
    for way in (lambda: canlii_case(c, language, g), lambda: uk_caselaw(c), lambda: canlii_legislation(c, language, g), lambda: justice_laws(c, language, g), lambda: legislation_gov_uk(c), lambda: courtlistener(c, g)):
        found = way()
        if found:
            return found
    return None


def source_anchor(page: str, kind: str, locator: str) -> str | None:
    """The fragment of a place on a page."""
    n = re.sub(r"^(?:par|sec|art)", "", locator)
    if kind == "paragraph":
        return f"par{n}" if n.isdecimal() else None
    m = re.fullmatch(r"(\d+(?:\.\d+)*)((?:\(\w+\))*)", n)
    if not m:
        return None
    if kind in ("article", "rule"):
        return f"{'art' if kind == 'article' else 'rule'}{m[1]}"
    if kind == "page":
        return f"page={m[1]}"
    if "/qc/laws/" in page:
        return "se:" + m[1].replace(".", "_")
    sub = re.match(r"\((\d+)\)", m[2])
    return f"sec{m[1]}" + (f"subsec{sub[1]}" if sub else "")


def with_pinpoint(page: str, c: dict) -> str:
    """A page at the one place that a citation pinpoints; the page itself where there are more, or a range."""
    if len(c["pinpoints"]) != 1 or c["pinpoints"][0]["last"]:
        return page
    p = c["pinpoints"][0]
    a = source_anchor(page, p["kind"], p["first"])
    return f"{page}#{a}" if a else page


def passage_locator(page: str, text: str) -> str:
    """A page with a text fragment that leads to a passage."""
    words = text.split()
    start = encode_component(" ".join(words[:6])).replace("-", "%2D")
    if len(words) <= 12:
        return f"{page.split('#')[0]}#:~:text={encode_component(' '.join(words)).replace('-', '%2D')}"
    return f"{page.split('#')[0]}#:~:text={start},{encode_component(' '.join(words[-6:])).replace('-', '%2D')}"


def is_canlii_url(u: str) -> bool:
    try:
        p = urlsplit(u)
        host = (p.hostname or "").rstrip(".").lower()
    except ValueError:
        return False
    return p.scheme in ("http", "https") and (host in ("canlii.org", "canlii.ca") or host.endswith((".canlii.org", ".canlii.ca")))


def canlii_search(text: str, field: str = "text") -> str | None:
    t = text.strip()
    return f"{CANLII}/en/#search/{field}={encode_component(t)}" if t and len(t) <= 4096 else None


def canlii_noteup(c: dict, text: str, g: Registry = SEED) -> str | None:
    page = canlii_case(c, "en", g)
    return f"{CANLII}/en/#search/origin1={encode_component(page.removeprefix(CANLII))}&nquery1={encode_component(text)}" if page else None


def canlii_pdf(u: str) -> str | None:
    """The PDF beside a decision's page."""
    m = re.fullmatch(r"https://www\.canlii\.org/(?:en|fr)(?:/\w+){1,2}/doc/(\d{4})/(\1\w+)/(\w+)\.html", u)
    return u[: -len("html")] + "pdf" if m and m[2] == m[3] else None


def canlii_pdf_page(u: str, page: int) -> str | None:
    p = canlii_pdf(u) or (u if u.endswith(".pdf") and is_canlii_url(u) else None)
    return f"{p}#page={page}" if p else None


def canlii_citation_key(s: str) -> str:
    """A legislation citation as CanLII's ids write it."""
    t = re.sub(r"\b((?:[A-Z]\.)+)(?=[\s,]|$)", lambda m: m[1].replace(".", ""), s)
    return slug(re.sub(r"\b(c|ch|Reg|r|s)\.(?=\s)", r"\1", t))


def canlii_citation_keys(s: str, g: Registry = SEED) -> list[str]:
    """All spellings of a citation's id: as written, in the other spellings of its series, with the year as CanLII writes it, without a pinpoint."""
    first = canlii_citation_key(s)
    out = [first]
    for row in g.series:
        names = list(dict.fromkeys(slug(x.replace(".", "")) for x in (row["abbreviation"], *row["variations"], *row["french"])))
        for n in names:
            if first.startswith(n + "-"):
                rest = first[len(n) :]
                out += [m + rest for m in names if m != n]
                if row["canlii_year"]:
                    y = re.fullmatch(r"(-\w+)-(\d{2,4})", rest)
                    if y:
                        out += [f"{m}{y[1]}-{canlii_year(y[2], row['canlii_year'])}" for m in names]
                if row["id"] == "rso":
                    out += [m + rest.replace(".", "") for m in names]
    out += [re.sub(r"-(?:s|ss|art|arts)-[\w.]+$", "", k) for k in out]
    return list(dict.fromkeys(out))


def legislation_lookup(s: str, g: Registry = SEED) -> dict:
    """Candidate ids of an enactment and its jurisdiction as CanLII names it."""
    keys = canlii_citation_keys(s, g)
    for row in g.series:
        if row["canlii"] and any(k.startswith(slug(row["abbreviation"]) + "-") for k in keys):
            mine = [k for k in keys if k.startswith(slug(row["abbreviation"]) + "-")]
            return {"candidates": [*mine, *(k for k in keys if k not in mine)], "jurisdiction": row["canlii"].split("/")[0]}
    return {"candidates": keys, "jurisdiction": None}


def canlii_routes(g: Registry = SEED) -> dict[str, str]:
    out = {}
    for r in g.courts:
        for code in r["neutral"]:
            if r["canlii"] and " " not in code:
                out[code] = r["canlii_fr"] if code in FRENCH_CODES and r["canlii_fr"] else r["canlii"]
    return out


def neutral_url(year_: Column, code: Column, number: Column, route: Column, language: Column) -> Column:
    """A decision's page from columns."""
    s = F.concat(year_, F.lower(code), number)
    return F.concat(F.lit(f"{CANLII}/"), language, F.lit("/"), route, F.lit("/doc/"), year_, F.lit("/"), s, F.lit("/"), s, F.lit(".html"))


#: Statute pages for readers, by the host of a machine-readable address.
def statute_page(u: str) -> str:
    u = re.sub(r"^(https://laws-lois\.justice\.gc\.ca/)(eng|fra)/XML/(\w[\w.-]*)\.xml$", r"\1\2/acts/\3/", u)
    return re.sub(r"^(https://www\.legislation\.gov\.uk/\w+/.+?)/data\.(?:xml|rdf|htm)$", r"\1", u)
