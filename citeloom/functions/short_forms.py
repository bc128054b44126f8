"""Short forms of names: inferred, normalised, and looked up."""

from __future__ import annotations

import re

from ..functions.formatting import case_name
from ..functions.text import edits, plain


def normalize(s: str) -> str:
    return plain(s)


def infer(style: str, kind: str = "case") -> list[str]:
    """Short forms that a style may go by: parties of a case, the acronym of an enactment, authors' surnames."""
    out: list[str] = []
    if kind == "case":
        m = re.match(r"^(.*)\s(?:v|c)\s(.+)$", case_name(style))
        for p in (m[2], m[1]) if m else (style,):
            if p != "R":
                out += [p, p.split()[0].strip(",")]
    elif kind in ("statute", "regulation", "constitution", "treaty"):
        words = re.findall(r"[A-ZÀ-Þ][\w'’-]*", style)
        if len(words) >= 2:
            out.append("".join(w[0] for w in words))
        out.append(re.sub(r",?\s+\d{4}$", "", style))
    else:
        authors = re.split(r",?\s+[“\"]", style)[0]
        out += surnames(authors)
    return [n for n in dict.fromkeys(out) if len(n) > 1]


def surnames(authors: str) -> list[str]:
    return [a.split()[-1] for a in re.split(r",\s*|\s+(?:and|&|et)\s+", authors) if a.split() and a.split()[-1][0].isupper() and a.split()[-1] not in ("ed", "eds")]


def reference_info(text: str) -> dict:
    """Whether a text is an ibid or supra, the note numbers it gives, and the text normalised."""
    kind = "ibid" if re.search(r"\b(?:ibid|id\.|idem)", text, re.I) else "supra" if re.search(r"\bsupra\b|précité|\babove\s+n|\(n\s*\d", text, re.I) else ""
    return {"kind": kind, "notes": [int(n) for n in re.findall(r"\b(?:notes?|nn?\.?)\s*(\d{1,4})\b", text, re.I)], "text": re.sub(r"\s+", " ", text.replace("’", "'").replace("“", '"').replace("”", '"')).strip()}


def supra_hint(text: str) -> str | None:
    """The name before a supra token."""
    m = re.match(r"^\s*(?:see(?: also)?|voir|cf)?\.?\s*(?P<n>.+?),?\s*(?:\bsupra\b|\bprécité|\babove\s+n|\(n\s*\d)", text, re.I)
    return m["n"].strip() if m else None


def reference_forms(text: str) -> list[str]:
    """The names that stand before the supra tokens of a text, clause by clause, normalised."""
    hints = [supra_hint(part) for part in re.split(r"[;.]\s+", text)]
    return list(dict.fromkeys(normalize(h) for h in hints if h))


def resolve_hint(hint: str, rows: list[dict]) -> dict:
    """The one row (target, short_form, names, text) that a hint means, tier by tier; a tier with several targets stops the search."""
    h = normalize(hint)
    tokens = set(h.split())
    tiers = (
        ("exact_sf", lambda r: normalize(r.get("short_form") or "") == h), ("token_sf", lambda r: bool(tokens) and tokens <= set(normalize(r.get("short_form") or "").split())),
        ("token_verb", lambda r: any(tokens and tokens <= set(normalize(n).split()) for n in r.get("names") or ())), ("bracket_definition", lambda r: any(normalize(b) == h for b in re.findall(r"\[([^\[\]]+)\]", r.get("text") or ""))),
    )
    for name, test in tiers:
        found = list(dict.fromkeys(r["target"] for r in rows if test(r)))
        if len(found) == 1:
            return {"target": found[0], "rule": name}
        if found:
            return {"target": None, "rule": f"ambiguous_{name}"}
    return {"target": None, "rule": "no_match"}


def near_name(a: str, b: str) -> bool:
    """Names that differ by one letter in a word of five letters or more."""
    return any(len(x) >= 5 and edits(x, y, 1) <= 1 for x in normalize(a).split() for y in normalize(b).split())


def reanchor(link: str, pinpoint_kind: str | None, value: str | None, form: str) -> str:
    """A link at a reference's own place: a bare supra drops the fragment, a bare ibid keeps it."""
    base = link.split("#")[0]
    if value:
        return f"{base}#{'par' if pinpoint_kind == 'paragraph' else 'sec' if pinpoint_kind == 'section' else 'page='}{value}"
    return link if form == "ibid" else base
