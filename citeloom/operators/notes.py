"""Notes split into the sources that they cite, and what each part says of its source."""

from __future__ import annotations

import re

from ..sources.registry import SEED, Registry
from .find import find

#: Kind of a part by the authority of its citation.
KIND = {"case": "case", "statute": "statute", "constitution": "statute", "regulation": "regulation", "court_rule": "regulation", "treaty": "treaty", "journal": "journal", "book": "book", "book_chapter": "book", "debate": "parliamentary", "bill": "parliamentary", "parliamentary_paper": "parliamentary", "webpage": "other"}
REFERENCE = re.compile(r"^\s*(?:see\s+|voir\s+)?(?:[A-ZÀ-Þ][^;]{0,120}?,?\s*)?(?:\b(?:ibid|supra|id\.|idem)\b|\bprécité|\babove\s+n|\(n\s*\d)", re.I)


def inside_quotes(text: str, at: int) -> bool:
    head = text[:at]
    return head.count("“") > head.count("”") or head.count('"') % 2 == 1


def depth(text: str, at: int) -> int:
    head = text[:at]
    return max(0, head.count("(") - head.count(")")) + max(0, head.count("[") - head.count("]"))


def pure_reference_clauses(text: str) -> list[str] | None:
    """The clauses of a note of up to 400 characters that are one to four back references and nothing else; None otherwise."""
    if len(text) > 400:
        return None
    clauses = [c.strip().rstrip(".").strip() for c in text.split(";")]
    if not 1 <= len(clauses) <= 4 or not all(c and REFERENCE.match(c) for c in clauses):
        return None
    return clauses


def boundaries(text: str, citations: list[dict]) -> list[int]:
    """Places where a note may be cut: semicolons, signals and connectives, each between two citations and outside quotes and brackets."""
    out = set()
    spans = [(c["full_span"]["start"], c["full_span"]["end"]) for c in citations]

    def cited(a: int, b: int) -> bool:
        return any(a <= s < b for s, _ in spans)

    for m in re.finditer(r";\s*(?:and\s+)?|,\s+(?:and\s+)?(?=(?:the\s+)?[A-ZÀ-Þ][^,;]{3,80}\b(?:Act|Code|Regulations?),)|(?<=[.])\s+(?=(?:See|But see|Cf|Voir)\b)|\s+(?=citing\s)", text):
        at = m.end()
        if inside_quotes(text, m.start()) or depth(text, m.start()) or any(s < m.start() < e for s, e in spans):
            continue
        before = max([0, *(x for x in out if x < at)])
        if cited(before, at) and cited(at, len(text)):
            out.add(at)
    return sorted(out)


def split(text: str, o, g: Registry = SEED, strict: bool = False) -> dict:
    """status and parts (start, end, text, fields); strict abstains where a clause cites nothing."""
    citations = find(text, g, o)
    cuts = [0, *boundaries(text, citations), len(text)]
    parts = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        s, e = a, b
        while s < e and text[s] in " ;\n":
            s += 1
        while e > s and (text[e - 1] in " ;\n"):
            e -= 1
        if s < e:
            body = re.sub(r",?\s*and$", "", text[s:e])
            mine = [c for c in citations if s <= c["span"]["start"] < e]
            parts.append({"start": s, "end": s + len(body), "text": body, "jurisdictionPriority": list(o.jurisdiction_priority), "fields": fields_of(body, mine)})
    clear = all(p["fields"]["kind"] != "none" for p in parts)
    if (strict or o.split_tier == "safest") and not clear:
        return {"status": "abstained", "parts": []}
    return {"status": "deterministic_complete" if clear else "partial", "parts": parts}


def fields_of(text: str, citations: list[dict]) -> dict:
    """Kind, pinpoints, short form and bare citation of a part."""
    full = [c for c in citations if c["form"] == "full"]
    back = [c for c in citations if c["form"] in ("ibid", "supra", "reference", "short")]
    known = [c for c in full if c["authority"] != "webpage"]
    if known:
        kind = KIND.get(known[0]["authority"], "other")
    elif full:
        kind = "other"
    elif back:
        kind = "reference"
    else:
        kind = "other" if re.search(r"[“\"].{4,}[”\"]|<\S+>", text) else "none"
    pins = [p for c in citations for p in c["pinpoints"]]

    def expanded(kinds: tuple[str, ...]) -> list[str]:
        out: list[str] = []
        for p in pins:
            if p["kind"] in kinds:
                if p["last"] and p["first"].isdecimal() and p["last"].isdecimal() and 0 < int(p["last"]) - int(p["first"]) <= 100:
                    out += [str(i) for i in range(int(p["first"]), int(p["last"]) + 1)]
                else:
                    out += [x for x in (p["first"], p["last"]) if x]
        return list(dict.fromkeys(out))

    return {
        "kind": kind, "status": "read" if full else "reference" if back else "unread", "paragraphs": expanded(("paragraph",)), "sections": expanded(("section", "subsection", "article", "rule")), "pages": expanded(("page",)),
        "short_form": next((c["explicit_short_name"] for c in full if c["explicit_short_name"]), None), "bare_citation": bare_citation(text, citations), "link": next((c["fields"]["url"] for c in full if c["fields"].get("url")), None),
    }


def bare_citation(text: str, citations: list[dict]) -> str:
    """A part without its signal, pinpoints, parentheticals and short form."""
    full = [c for c in citations if c["form"] == "full"]
    if not full:
        return strip_tail(text)
    c = full[0]
    style = (c.get("style") or {}).get("text")
    return f"{style}, {c['span']['text']}" if style else c["span"]["text"]


def strip_tail(text: str) -> str:
    """A text without notes of emphasis and omission at its end."""
    return re.sub(r"(?:\s*[\[(](?:emphasis|footnotes?|citations?|translated|italics)[^\])]*[\])])+\s*\.?$", "", text).strip()


def quoted_titles(text: str) -> list[str]:
    return list(dict.fromkeys(m[1] or m[2] for m in re.finditer(r"“([^“”]{3,300})”|\"([^\"]{3,300})\"", text)))


def references(parts: list[dict], citations: list[dict], resolutions: list[dict]) -> list[dict]:
    """Which authority each part cites: its own full citations, or what its back references resolve to."""
    to = {r["index"]: r["antecedent"] for r in resolutions}
    out = []
    for i, p in enumerate(parts):
        for c in citations:
            if p["start"] <= c["span"]["start"] < p["end"]:
                target = c["index"] if c["form"] == "full" else to.get(c["index"])
                if target is not None:
                    out.append({"part": i, "index": c["index"], "authority": target})
    return out
