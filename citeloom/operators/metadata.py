"""What stands around a citation's core: style of cause, signal, pinpoints, parentheticals, history."""

from __future__ import annotations

import re

from ..sources.registry import Registry
from . import grammar as gr
from .classify import court_of_text

CONNECTORS = frozenset("of the and de du des la le les et for & in à l' d' re ex parte on au aux upon".split())
#: Abbreviations after which a point ends no sentence.
ABBREVIATED = re.compile(r"(?:\b(?:Inc|Ltd|Co|Corp|Bros|Mr|Mrs|Ms|Dr|St|Hon|No|al|Cie|Assn|Dept|Gen|Att|vs?|c)|\b[A-Z]|\.com|\d)\.$")
SINGLE = re.compile(r"(?:^|(?<=[;.:]\s)|(?<=\s))((?:Reference re|Renvoi relatif|In re|Re|Ex parte)\s+[^;:]+?|[A-ZÀ-Þ][^;:.]*?\(Re\)|[A-ZÀ-Þ][^;:.]*?,\sRe)\s*,?\s*$")
SIGNAL_BEFORE = re.compile(rf"(?:^|[.;:!?)\]\n]\s*)(?P<s>{gr.SIGNALS}),?\s*(?:the\s+)?$", re.I)
#: What signals begin with, in either case; ſ is a small s too.
SIGNAL_INITIALS = frozenset("sSſcCbBeEaAvVmM")
SIGNAL_FIRST = re.compile(rf"\s*(?:{gr.SIGNALS}),?\s+(?=\S)", re.I)
RANGE = re.compile(rf"(?P<first>{gr.VALUE})(?:\s*(?:[-–—]|to\b|à\b)\s*(?P<last>{gr.VALUE}|(?:\([\w.]+\))+))?")
BREAK = re.compile(r"[.!?;:]\s+|\n\s*\n|[“\"]")
VERSUS = re.compile(r"(?<=\s)(?:vs?|V|c)\.?(?=\s+[\"“(]?[A-Z0-9À-Þ])")
BRACKET_END = re.compile(r"\((?:\d|see\b|[a-z])[^()]*\)$")
WORD = re.compile(r"\S+")
BLANKS = re.compile(r"\s*")
#: Characters after which nothing more of a citation is read.
ENDING = frozenset(".;:|!?\"“”")
LAST_PAGE = re.compile(r"(?P<lead>\s+)(?P<values>\d+)(?=\s*(?:[.;,]|$))")
LEADING = re.compile(r"\s*(?:In|Under|Dans|citing|quoting|and|but|the case of|the)\s+(?=[A-Z0-9])")
#: Of each phrase of later history a part; where a text of ASCII has none of them it states none.
RELATED = ("leave", "autorisation", "appe", "aff", "rev", "conf", "inf", "var", "overruled", "cert", "cit", "quot")
LABEL = re.compile(r"^\s*(?:\[?\d{1,4}\]|\d{1,3}\.|\([a-z0-9]{1,3}\))\s+")


def span(text: str, start: int, end: int) -> dict:
    return {"start": start, "end": end, "text": text[start:end]}


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in " \t\n,;":
        start += 1
    while end > start and text[end - 1] in " \t\n,;":
        end -= 1
    return start, end


def sentence_floor(text: str, floor: int, end: int) -> int:
    """The place after the last break of a sentence, clause or paragraph between two places."""
    for m in reversed(list(BREAK.finditer(text[floor:end]))):
        at = floor + m.start()
        if text[at] == "." and (ABBREVIATED.search(text[max(floor, at - 12) : at + 1]) or text[floor + m.end() : floor + m.end() + 1].islower()):
            continue
        if text[at] == ":" and not text[floor + m.end() : end].strip():
            continue
        return floor + m.end()
    return floor


def _without_lead(text: str, start: int, end: int) -> int:
    """start moved past a paragraph's label, a signal and words that lead in."""
    while True:
        rest = text[start:end]
        m = LABEL.match(rest) or (rest.lstrip()[:1] in SIGNAL_INITIALS and SIGNAL_FIRST.match(rest)) or LEADING.match(rest)
        if not m or m.end() >= len(rest):
            return start
        start += m.end()


def related(text: str) -> bool:
    """Whether a text may state later history."""
    if not text.isascii():
        return True
    low = text.lower()
    return any([w in low for w in RELATED])


def case_style(text: str, floor: int, start: int) -> tuple[int, int, tuple[str, str] | None] | None:
    """Extent of a case's style before its core, and its parties."""
    low = sentence_floor(text, floor, start)
    a, b = trimmed(text, low, start)
    seg = text[a:b]
    if related(seg):
        relations = list(gr.RELATION.finditer(text, a, b))
        if relations:
            a, _ = trimmed(text, relations[-1].end(), b)
            seg = text[a:b]
    versus = list(VERSUS.finditer(seg))
    if not versus:
        m = SINGLE.search(seg)
        if not m or len(m[1]) > 250:
            return None
        s = a + m.start(1)
        return s, a + m.end(1), None
    v = versus[-1]
    left = seg[: v.start()].rstrip()
    if left.endswith((")", "\n")) and BRACKET_END.search(left):
        return None
    begin, depth = len(left), 0
    for t in reversed(list(WORD.finditer(left))):
        w = t[0]
        depth += w.count(")") - w.count("(")
        core = w.strip("(),.'’\"“”")
        ok = depth > 0 or w.startswith("(") or core[:1].isupper() or core[:1].isdigit() or core.lower() in CONNECTORS or re.match(r"[dl]['’]", core) or core in ("et", "al", "ors") or "." in w[:-1]
        if not ok:
            break
        begin = t.start()
    begin = _without_lead(seg, begin, len(left))
    while begin < len(left) and left[begin:].split() and left[begin:].split()[0].strip(",") in CONNECTORS and left[begin:].split()[0] not in ("the",):
        begin += len(left[begin:].split()[0])
        begin += len(left[begin:]) - len(left[begin:].lstrip())
    plaintiff, defendant = left[begin:].strip(), seg[v.end() :].strip()
    if not plaintiff or len(plaintiff) + len(defendant) > 250:
        return None
    return a + begin, b, (plaintiff, defendant)


def title_style(text: str, floor: int, start: int) -> tuple[int, int] | None:
    """Extent of a title before the core of an enactment or treaty."""
    a, b = trimmed(text, sentence_floor(text, floor, start), start)
    seg = text[a:b]
    a += _without_lead(seg, 0, len(seg))
    m = re.search(r"(?:^|,\s(?:and\s)?(?:the\s)?|\binclude\s(?:the\s)?|\bunder\s(?:the\s)?)(?=[A-ZÀ-Þ][^,]*(?:,\s\d{4})?(?:,\s\d+\s\w+\s\d{4})?(?:\s\(\w+\))?$)", text[a:b])
    if m:
        a += m.end()
    title = text[a:b]
    if title[:1].isupper() and len(title) <= 200 and (gr.TITLE_WORD.search(title) or re.fullmatch(r"[A-Z]{2,8}", title)):
        return a, b
    return None


def work_style(text: str, floor: int, start: int) -> tuple[int, int] | None:
    """Extent of authors and title before the core of an article, chapter or book."""
    low = floor
    for m in re.finditer(r"[;.]\s+(?=[A-Z])|\n\s*\n", text[floor:start]):
        at = floor + m.start()
        inside = (text[floor:at].count('"') % 2) or text[floor:at].count("“") > text[floor:at].count("”")
        if inside or (text[at] == "." and ABBREVIATED.search(text[max(floor, at - 12) : at + 1])):
            continue
        low = floor + m.end()
    a, b = trimmed(text, low, start)
    a += _without_lead(text[a:b], 0, b - a)
    return (a, b) if a < b and text[a].isupper() or text[a : a + 1] in '"“' else None


def signal(text: str, floor: int, start: int) -> dict | None:
    """The signal that stands right before a citation, in lower case and without points."""
    floor = max(floor, start - 200)
    before = text[floor:start].rstrip()
    before = before[:-1] if before.endswith(",") else before
    if not before or not before[-1].isalpha() and before[-2:].lower() not in ("g.", "f."):
        return None
    m = SIGNAL_BEFORE.search(text[floor:start])
    if not m or (floor and not m.start("s") and text[floor - 1 : floor].isalnum()):
        return None
    words = re.sub(r"[.,]", "", m["s"].lower())
    return {"start": floor + m.start("s"), "end": floor + m.end("s"), "text": " ".join(words.split())}


def range_end(first: str, last: str) -> str:
    """The last value of a range, written out: 191-92 ends at 192, 7(2)-(4) at 7(4)."""
    if last.startswith("("):
        return first[: first.rfind("(")] + last if first.count("(") == last.count("(") else re.match(r"[^(]*", first)[0] + last
    if first.isdecimal() and last.isdecimal() and len(last) < len(first):
        return first[: len(first) - len(last)] + last
    return last


def values(kind: str, text: str, at: int) -> list[dict]:
    out = []
    for m in RANGE.finditer(text):
        last = range_end(m["first"], m["last"]) if m["last"] else None
        out.append({"kind": kind, "span": {"start": at + m.start(), "end": at + m.end(), "text": m[0]}, "first": m["first"], "last": last})
    return out


def balanced(text: str, at: int, limit: int) -> int | None:
    """The place after the parenthesis that closes the one at a place: at most 600 characters on, on the same line."""
    depth = 0
    for i in range(at, min(limit, at + 600)):
        if text[i] == "\n":
            return None
        depth += (text[i] in "([") - (text[i] in ")]")
        if not depth:
            return i + 1
    return None


def parenthetical_kind(content: str, g: Registry) -> tuple[str, dict | None]:
    if re.fullmatch(r"QL|WL(?: Can)?|CanLII|Lexis(?:Nexis)?|available on .*|AZ-\d+", content):
        return "source", None
    if re.match(r"(?:Transcript|Factum|Memorandum|Affidavit|Statement of Claim|Record)\b", content):
        return "record", None
    court = court_of_text(g, content)
    if court:
        return "court", court
    if re.fullmatch(r"(?:\d{1,2}\s+)?(?:\w{3,9}\.?\s+)?(?:\d{1,2},\s*)?(?:1[6-9]|20|21)\d{2}", content):
        return "date", None
    return "explanatory", None


def tail(text: str, c: dict, limit: int, g: Registry) -> int:
    """Read pinpoints, parentheticals and a short form after a core; the place where they end."""
    at = c["span"]["end"]
    gap = BLANKS.match(text, at).end()
    if gap >= limit or text[gap] in ENDING:
        return at
    reported = c["format"] == "reporter" and "." in (c["fields"].get("reporter") or "") or (c["authority"] == "journal" and "." in (c["fields"].get("reporter") or ""))
    while True:
        m = gr.PINPOINT.match(text, at, limit)
        if m and not (m["page"] and not m["lead"].strip() and not m["lead"]):
            kind = next(k for k, _ in gr.PIN_WORDS if m[k])
            if kind == "schedule" and c["authority"] in ("statute", "regulation") and not c["fields"].get("schedule"):
                c["fields"]["schedule"] = m["values"]
            else:
                c["pinpoints"] += values(kind, m["values"], m.start("values"))
            at = m.end()
            continue
        m = gr.BARE_PAGE.match(text, at, limit)
        if m:
            c["pinpoints"] += values("page", m["values"], m.start("values"))
            at = m.end()
            continue
        m = gr.BRACKETED.match(text, at, limit)
        if m and (c["form"] != "full" or c["format"] in ("neutral", "reporter")) and not (m["lead"] == "" and at == c["span"]["end"] and c["form"] == "full"):
            c["pinpoints"].append({"kind": "paragraph", "span": span(text, m.start() + len(m["lead"]), m.end()), "first": m["first"], "last": m["last"]})
            at = m.end()
            continue
        if reported or c["form"] == "supra":
            m = gr.REPORT_PAGE.match(text, at, limit) if reported or at == c["span"]["end"] else None
            if not m and c["form"] == "supra" and at == c["span"]["end"]:
                m = LAST_PAGE.match(text, at, limit)
            if m:
                c["pinpoints"] += values("page", m["values"], m.start("values"))
                at = m.end()
                continue
        m = gr.SHORT_FORM.match(text, at, limit)
        if m and not gr.NOT_SHORT.search(name := (m["name"] or m["quoted"])) and not re.fullmatch(r"\d{4}", name):
            if c["explicit_short_name"] is None:
                c["explicit_short_name"] = name.strip()
                at = m.end()
                continue
        gap = BLANKS.match(text, at).end()
        if gap < limit and text[gap] == "(" and (end := balanced(text, gap, limit)):
            content = text[gap + 1 : end - 1]
            kind, court = parenthetical_kind(content, g)
            c["parentheticals"].append({"kind": kind, "span": span(text, gap, end), "content": content})
            if court and (not c["court"] or c["format"] in ("can_lii", "database")):
                c |= {"court": {"id": court["id"], "text": content}, "jurisdiction": court["jurisdiction"]}
            year = re.search(r"(?:1[6-9]|20|21)\d{2}$", content)
            if kind in ("date", "court") and year and not c["fields"].get("year"):
                c["fields"] |= {"year": year[0], "year_number": int(year[0])}
            at = end
            continue
        return at


def attach_history(text: str, citations: list[dict]) -> None:
    """Relations stated after a citation; the next one is its target where the gap holds nothing else."""
    full = [c for c in citations if c["form"] == "full"]
    for i, c in enumerate(full):
        nxt = full[i + 1] if i + 1 < len(full) else None
        end = nxt["full_span"]["start"] if nxt else min(len(text), c["full_span"]["end"] + 120)
        gap = text[c["full_span"]["end"] : end]
        m = gr.RELATION.match(gap.lstrip(" ,;("))
        if not m or c["authority"] != "case":
            continue
        at = c["full_span"]["end"] + len(gap) - len(gap.lstrip(" ,;("))
        relation = next(r for k, (_, r) in enumerate(gr.HISTORY) if m[f"r{k}"])
        rest = gap[at + m.end() - c["full_span"]["end"] :]
        target = nxt["index"] if nxt and re.fullmatch(r"[\s,]*(?:\([^()]*\))?[\s,]*", rest) else None
        c["history"].append({"relation": relation, "span": span(text, at, at + m.end()), "target": target})
