"""Finding citations in one text: hits of all families, overlaps settled, each read with what stands around it."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Collection, Iterator
from itertools import accumulate

from ..functions.text import plain
from ..schema import GUIDES
from ..sources.registry import SEED, Registry
from . import grammar as gr
from . import metadata as md
from .classify import classify, instrument, listed

PRIMARY = frozenset("neutral numberless canlii database law_reports reporter unknown_reporter short code statute regulation_qc regulation_crc regulation_rro regulation regnal uk_act charter journal".split())
#: Families of each authority, so that those not asked for are not scanned for.
FAMILIES_OF = {
    "case": {"neutral", "numberless", "canlii", "database", "law_reports", "reporter", "unknown_reporter", "short"}, "statute": {"statute", "regnal", "uk_act", "code", "url"}, "regulation": {"regulation", "regulation_qc", "regulation_crc", "regulation_rro", "code"},
    "court_rule": {"regulation", "regulation_rro"}, "constitution": {"charter", "constitution", "regnal"}, "treaty": {"treaty"}, "bill": {"bill"}, "debate": {"debate"}, "parliamentary_paper": {"paper"},
    "journal": {"journal"}, "book": {"book"}, "book_chapter": {"book"}, "webpage": {"url"},
}


ANY = frozenset(GUIDES)
#: Guides whose forms a family is; other families are of all guides.
FAMILY_GUIDES = {"short": {"bluebook"}, "code": {"bluebook", "mcgill"}, "paper": {"oscola", "aglc", "nzlsg"}, "regulation_qc": {"mcgill", "coal"}, "bill": {"mcgill", "coal", "bluebook"}}


#: Literals of which a text must hold one for a family to occur in it; looked for before the family's pattern runs.
NEEDS = {
    "canlii": ("CanLII",), "law_reports": ("LR",), "charter": ("Constitution Act", "constitutionnelle"), "constitution": ("Constitution Act", "constitutionnelle"), "uk_act": ("Act",), "regnal": ("Vict", "Geo", "Will", "Eliz", "Edw"),
    "treaty": ("UNTS", "ETS", "ILM", "TS"), "bill": ("Bill",), "debate": ("Deb", "Débats"), "paper": ("Cm",), "book": ("(",), "url": ("http", "online"), "code": ("§", "s.", "sec."), "regulation_rro": ("RRO", "R.R.O"), "regulation_crc": ("CRC", "C.R.C"),
    "regulation_qc": ("RLRQ", "CQLR", "LRQ"),
}
DIGIT = re.compile(r"\d")
LEAD = re.compile(rf"(?:{gr.SIGNALS})\s+", re.I)


def blank(form: str, start: int, end: int, text: str) -> dict:
    s = md.span(text, start, end)
    return {
        "index": 0, "form": form, "authority": "unknown", "format": None, "span": s, "signal": None, "full_span": dict(s), "style": None, "parties": None, "fields": {}, "court": None, "jurisdiction": None, "language": None,
        "pinpoints": [], "parentheticals": [], "history": [], "short_name": None, "explicit_short_name": None, "parallel_group": None, "antecedent": None, "antecedent_reason": None, "key": None, "interpretations": [], "reasons": [],
        "authority_cluster": None, "url": None,
    }


def settle(hits: list[tuple[int, int]]) -> list[int]:
    """Of intervals the indices of those kept: by start, longest first, each that begins at or after the last kept end."""
    kept, end = [], 0
    for i in sorted(range(len(hits)), key=lambda i: (hits[i][0], -hits[i][1])):
        if hits[i][0] >= end:
            kept.append(i)
            end = hits[i][1]
    return kept


def settle_named(hits: list[tuple[int, int, str]]) -> list[int]:
    """Of overlapping names the longer one wins, of equals the earlier; the earlier yields if only digits are shared."""
    order = sorted(range(len(hits)), key=lambda i: (hits[i][0], hits[i][1]))
    kept: list[int] = []
    for i in order:
        while kept and hits[kept[-1]][1] > hits[i][0]:
            a, b = hits[kept[-1]], hits[i]
            shared = a[2][b[0] - a[0] : a[1] - a[0]]
            if (shared.strip().isdecimal() and b[1] > a[1]) or b[1] - b[0] > a[1] - a[0]:
                kept.pop()
                continue
            break
        else:
            kept.append(i)
    return kept


def repair(text: str) -> str:
    """Common misreadings of scans, of the same length: {2016} and (2016] for [2016], l6 for 16 in years."""
    text = re.sub(r"[\[({](?=(?:1[6-9]|20)\d{2}\])|(?<=\W)[{](?=(?:1[6-9]|20)\d{2}\})", "[", text)
    text = re.sub(r"(?<=\[(?:1[6-9]|20)\d\d)\}", "]", text)
    return re.sub(r"(?<=[\[(])[lI](?=9\d\d[\])])", "1", text)


def chosen(families: list[tuple[str, re.Pattern]], styles: tuple[str, ...], reporter_names: bool, authorities: tuple[str, ...] | None) -> list[tuple[str, re.Pattern, tuple[str, ...]]]:
    """(family, pattern, needs) of the families that options ask for."""
    families = [x for x in families if FAMILY_GUIDES.get(x[0], ANY) & set(styles)]
    if not reporter_names:
        families = [x for x in families if x[0] not in ("unknown_reporter", "law_reports", "journal")]
    if authorities is not None:
        wanted = set().union(*(FAMILIES_OF.get(a, set()) for a in authorities))
        families = [x for x in families if x[0] in wanted]
    return [(f, p, NEEDS.get(f, ())) for f, p in families]


def matches_at(pattern: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """The matches of a pattern that can begin at some places only, in order and without overlaps."""
    end = 0
    for p in places:
        if p >= end and (m := pattern.match(text, p)):
            yield m
            end = m.end()


#: What chosen() gave, by its families and options; the families are held so that their identity stays theirs.
_CHOSEN: dict[tuple, tuple] = {}


def anchors(text: str, g: Registry, o) -> list[dict]:
    """Cores of full and short citations, in order, without overlaps."""
    read = repair(text) if o.ocr_repairs else text
    all_ = gr.families(g)
    asked = id(all_), o.styles, o.reporter_names, o.authorities
    if asked not in _CHOSEN:
        if len(_CHOSEN) >= 64:
            _CHOSEN.clear()
        _CHOSEN[asked] = all_, chosen(all_, *asked[1:])
    families = _CHOSEN[asked][1]
    found = []
    if not DIGIT.search(read):
        families = [x for x in families if x[0] in ("charter", "constitution", "url")]
    years = [m.start() for m in gr.YEAR_AT.finditer(read)]
    words, begun, quoted = set(gr.WORD.findall(read)), gr.beginnings(g), '"' in read or "”" in read
    for order, (family, pattern, needs) in enumerate(families):
        if needs:
            for n in needs:
                if n in read:
                    break
            else:
                continue
        # a journal that the registry does not know may stand after a quoted title
        if family in begun and words.isdisjoint(begun[family]) and not (quoted and family == "journal"):
            continue
        for m in matches_at(pattern, read, years) if family in gr.BY_YEAR else pattern.finditer(read):
            a, b = md.trimmed(text, m.start(), m.end())
            c = blank("full", a, b, text)
            if classify(c, family, m, g, o):
                found.append((a, b, family not in PRIMARY, order, c))
    primary = [x for x in found if not x[2]]
    primary.sort(key=lambda x: (x[0], -x[1], x[3]))
    kept = [primary[i] for i in settle([(x[0], x[1]) for x in primary])]
    rest = [x for x in found if x[2] and not any(x[0] < k[1] and k[0] < x[1] for k in kept)]
    rest.sort(key=lambda x: (x[0], -x[1], x[3]))
    kept += [rest[i] for i in settle([(x[0], x[1]) for x in rest])]
    return [x[4] for x in sorted(kept, key=lambda x: x[0])]


def style(text: str, c: dict, floor: int) -> None:
    """The style before a full citation's core, and what follows from it."""
    start, kind = c["span"]["start"], c["authority"]
    if kind == "case" and c["form"] == "full":
        s = md.case_style(text, floor, start)
        if s:
            c["style"] = md.span(text, s[0], md.trimmed(text, s[0], s[1])[1])
            if s[2]:
                c["parties"] = {"plaintiff": s[2][0].strip(" ,"), "defendant": s[2][1].strip(" ,")}
            c["reasons"].append("same_text_style")
    elif c["form"] == "short":
        m = re.search(r"(?P<n>[A-Z][\w'’.-]+),?\s*$", text[floor:start])
        if m:
            c["style"] = md.span(text, floor + m.start("n"), floor + m.end("n"))
    elif kind in ("statute", "regulation", "constitution", "treaty"):
        part = c["fields"].get("part")
        if part:
            m = re.search(r"(?P<t>Canadian Charter of Rights and Freedoms|Charte canadienne des droits et libertés)(?:,\s*(?P<p>(?:ss?|arts?)\.?\s*[\d.()a-z, -]*[\d)]))?,\s*$", text[floor:start])
            if m:
                c["style"] = md.span(text, floor + m.start("t"), floor + m.end("t"))
                if m["p"]:
                    pin = gr.PINPOINT.match(text, floor + m.start("p"))
                    if pin:
                        c["pinpoints"] = md.values(next(k for k, _ in gr.PIN_WORDS if pin[k]), pin["values"], pin.start("values"))
        elif c["format"] != "code" and not c["fields"].get("title"):
            s = md.title_style(text, floor, start)
            if s:
                c["style"] = md.span(text, *s)
        elif c["fields"].get("title"):
            end = start + len(c["fields"]["title"])
            c["style"] = md.span(text, start, end)
        named = instrument((c["style"] or {}).get("text"))
        if named == "constitution" and kind == "statute" or named == "court_rule" and kind == "regulation" or named == "treaty" and kind == "statute":
            c["authority"] = named
    elif kind in ("book", "journal"):
        if not (kind == "journal" and text[start].isdigit()):
            s = md.work_style(text, floor, start)
            if s:
                c["style"] = md.span(text, *s)
                if kind == "book" and re.search(r"[\"”]\s+in\s|,?\s+eds?,", c["style"]["text"]) and c["fields"].get("page"):
                    c["authority"] = "book_chapter"
    elif kind == "webpage":
        s = md.title_style(text, floor, start)
        if s:
            c["style"] = md.span(text, *s)
            c["authority"] = instrument(c["style"]["text"]) or "statute"
    c["short_name"] = (c["style"] or {}).get("text")


#: Code points before a citation in which its style, the name of a reference or a title are looked for.
BEFORE = 1500


class Taken:
    """Extents of citations, for questions about places that take a search and not a walk."""

    def __init__(self, citations: list[dict]):
        spans = sorted((c["full_span"]["start"], c["full_span"]["end"]) for c in citations)
        self.starts, self.reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
        self.ends = sorted(e for _, e in spans)

    def overlaps(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.reach[i - 1] > start

    def end_before(self, at: int) -> int:
        """The last end at or before a place, 0 if there is none."""
        i = bisect_right(self.ends, at)
        return self.ends[i - 1] if i else 0

    def start_from(self, at: int, default: int) -> int:
        """The first start at or after a place."""
        i = bisect_left(self.starts, at)
        return self.starts[i] if i < len(self.starts) else default


def back_references(text: str, cores: Taken) -> list[dict]:
    out, last = [], 0
    for m in gr.backs(text):
        # a core's style begins before it, so what lies in a style is part of the core's extent
        if cores.overlaps(m.start(), m.end()):
            continue
        form = "ibid" if m["ibid"] else "supra"
        c = blank(form, m.start(), m.end(), text)
        c["reasons"].append("reference_grammar")
        note = next((m[f"n{i}"] for i in range(1, 6) if m[f"n{i}"]), None)
        if note:
            c["fields"]["note"] = int(note)
        if "précit" in m[0]:
            c["language"] = "fr"
        if form == "supra":
            floor = max(cores.end_before(m.start()), last, m.start() - 300)
            n = gr.name_before(text[floor : m.start()])
            if n:
                s = n.start("name")
                lead = LEAD.match(n["name"])
                s += lead.end() if lead else 0
                name = text[floor + s : floor + n.end("name")]
                if name:
                    c["short_name"] = name
                    c["style"] = md.span(text, floor + s, floor + n.end("name"))
            elif form == "supra" and m["n3"] and not n:
                continue
        last = m.end()
        out.append(c)
    return out


def is_crown(name: str) -> bool:
    return plain(name) in ("r", "regina", "rex", "the queen", "the king", "her majesty the queen", "his majesty the king", "la reine", "le roi", "sa majeste la reine", "crown")


FIRST_NAME = re.compile(r"[A-ZÀ-Þ][\w'’-]+")
WORD = re.compile(r"\w+")
#: First words of names up to which a text is searched for each; it is read word by word for more.
FEW_WORDS = 16
JOINING = re.compile(r"\s*\band\s+$")


def places(text: str, words: Collection[str]) -> Iterator[tuple[int, str]]:
    """(place, word) wherever one of some words stands as a whole word of a text, in order."""
    if len(words) > FEW_WORDS:
        for m in WORD.finditer(text):
            if m[0] in words:
                yield m.start(), m[0]
        return
    found = []
    for w in words:
        at = text.find(w)
        while at >= 0:
            end = at + len(w)
            if not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) and not (text[end : end + 1].isalnum() or text[end : end + 1] == "_"):
                found.append((at, w))
            at = text.find(w, end)
    found.sort()
    yield from found


#: Words that make no name by themselves.
GENERIC = frozenset("canada ontario quebec alberta court act code state states united board commission minister director attorney general procureur".split())


def names_of(c: dict) -> list[str]:
    """Names under which a full citation may be referred to later."""
    p = c.get("parties") or {}
    out = [c.get("explicit_short_name"), p.get("defendant"), p.get("plaintiff")]
    first = [FIRST_NAME.match(n) for n in (p.get("defendant"), p.get("plaintiff")) if n]
    out += [m[0] for m in first if m]
    return [n for n in dict.fromkeys(out) if n and len(n) >= 3 and n[0].isupper() and not is_crown(n) and plain(n) not in GENERIC]


def name_references(text: str, citations: list[dict], o) -> list[dict]:
    """Names of earlier full citations with a pinpoint, or joined by and to another reference: one pass over the words of the text."""
    since: dict[str, tuple[int, bool]] = {}
    for c in citations:
        if c["form"] == "full":
            for n in names_of(c):
                at = 0 if o.early_references else c["full_span"]["end"]
                if n not in since or at < since[n][0]:
                    since[n] = at, n == c.get("explicit_short_name")
    by_word: dict[str, list[str]] = {}
    for n in sorted(since, key=len, reverse=True):
        by_word.setdefault(WORD.match(n)[0], []).append(n)
    if not by_word:
        return []
    taken, last, out = Taken(citations), 0, []
    ends = {c["full_span"]["end"] for c in citations if c["form"] in ("supra", "ibid", "reference")}
    for a, w in places(text, by_word):
        for n in by_word[w]:
            b = a + len(n)
            at, short = since[n]
            if a < max(at, last) or not text.startswith(n, a) or text[b : b + 1] in ("'", "’") or text[b : b + 1].isalnum() or text[b : b + 1] == "_" or taken.overlaps(a, b):
                continue
            pin = gr.PINPOINT.match(text, b) or gr.BARE_PAGE.match(text, b)
            joining = JOINING.search(text[max(0, a - 40) : a]) if a and text[a - 1].isspace() else None
            joined = joining and a - len(joining[0]) in ends
            if not joined and not (pin and pin["lead"].strip()):
                continue
            r = blank("reference", a, b, text)
            r |= {"short_name": n}
            r["reasons"].append("short_form" if short else "case_name")
            out.append(r)
            ends.add(b)
            last = b
            break
    return out


def find(text: str, g: Registry = SEED, o=None, notes: list[dict] | None = None) -> list[dict]:
    """All citations of a text, by place, with index; notes: ranges that no citation crosses. Takes time in proportion to the text."""
    edges = sorted({e for n in notes or [] for e in (n["start"], n["end"])})

    def floor_of(at: int) -> int:
        i = bisect_right(edges, at)
        return edges[i - 1] if i else 0

    def limit_of(at: int) -> int:
        i = bisect_right(edges, at)
        return min(len(text), edges[i]) if i < len(edges) else len(text)

    cores = [c for c in anchors(text, g, o) if limit_of(c["span"]["start"]) >= c["span"]["end"]]
    end = 0
    for i, c in enumerate(cores):
        floor = max(end, floor_of(c["span"]["start"]))
        style(text, c, max(floor, c["span"]["start"] - BEFORE))
        nxt = cores[i + 1]["span"]["start"] if i + 1 < len(cores) else len(text)
        back = next(gr.backs(text, c["span"]["end"], min(nxt, c["span"]["end"] + 4 * BEFORE)), None)
        limit = min(nxt, back.start() if back and back["supra"] is None else nxt, limit_of(c["span"]["end"]))
        stop = md.tail(text, c, limit, g)
        begin = min(c["style"]["start"] if c["style"] else c["span"]["start"], c["span"]["start"])
        c["full_span"] = md.span(text, begin, stop)
        c["signal"] = md.signal(text, floor, begin)
        if c["authority"] == "case" and c["explicit_short_name"] is None and c["form"] == "short":
            c["short_name"] = (c["style"] or {}).get("text")
        end = stop
    cores = [c for c in cores if c["jurisdiction"] is None or listed(c["jurisdiction"], o.jurisdictions)]
    full = Taken(cores)
    refs = back_references(text, full)
    own = sorted(c["span"]["start"] for c in refs)
    for c in refs:
        i = bisect_left(own, c["span"]["end"])
        later = min(full.start_from(c["span"]["end"], len(text)), own[i] if i < len(own) else len(text))
        stop = md.tail(text, c, min(limit_of(c["span"]["end"]), later), g)
        begin = c["style"]["start"] if c["style"] else c["span"]["start"]
        c["full_span"] = md.span(text, begin, stop)
        c["style"] = None
        c["signal"] = md.signal(text, max(floor_of(begin), full.end_before(begin)), begin)
    found = sorted([*cores, *refs], key=lambda c: c["full_span"]["start"])
    named = name_references(text, found, o)
    taken, own = Taken(found) if named else None, [c["span"]["start"] for c in named]
    for c in named:
        i = bisect_left(own, c["span"]["end"])
        later = min(taken.start_from(c["span"]["end"], len(text)), own[i] if i < len(own) else len(text))
        stop = md.tail(text, c, min(limit_of(c["span"]["end"]), later), g)
        c["full_span"] = md.span(text, c["span"]["start"], stop)
    found += named
    taken = Taken(found) if "§" in text else None
    for m in gr.SECTION_SIGN.finditer(text) if taken else ():
        before = taken.end_before(m.start())
        if taken.overlaps(m.start(), m.end()) or before and m.start() - before < 40 and re.fullmatch(r"\s*(?:at)?\s*", text[before : m.start()]):
            continue
        c = blank("unknown", m.start(), m.end(), text)
        c["fields"]["section"] = m["section"]
        found.append(c)
    out, last, seen = [], 0, set()
    for c in sorted(found, key=lambda c: (c["full_span"]["start"], -c["full_span"]["end"])):
        if c["full_span"]["start"] >= last and (c["span"]["start"], c["span"]["end"]) not in seen:
            seen.add((c["span"]["start"], c["span"]["end"]))
            out.append(c)
            last = c["full_span"]["end"]
    absorb_subjects(text, out)
    join_legislation(text, out)
    join_links(text, out)
    for i, c in enumerate(out):
        c["index"] = i
    md.attach_history(text, out)
    return out


def without(citations: list[dict], gone: list[dict]) -> None:
    """Take citations, as the objects they are, out of a list."""
    ids = set(map(id, gone))
    if ids:
        citations[:] = [c for c in citations if id(c) not in ids]


def absorb_subjects(text: str, citations: list[dict]) -> None:
    """A comment on a decision takes in the decision that its title names: one citation, of the comment."""
    if not any(c["authority"] in ("journal", "book_chapter") for c in citations):
        return
    gone, ends = [], Taken(citations)
    for a, b in zip(citations, citations[1:], strict=False):
        if b["authority"] not in ("journal", "book_chapter") or a["authority"] != "case":
            continue
        low = max(0, b["span"]["start"] - 400)
        quoted = re.search(r"[“\"]([^“”\"]{3,300})[”\"]\s*$", text[low : b["span"]["start"]])
        if quoted and low + quoted.start() < a["span"]["start"]:
            floor = max(ends.end_before(low + quoted.start()), b["span"]["start"] - BEFORE)
            s = md.work_style(text, floor, b["span"]["start"])
            gone.append(a)
            b["style"] = md.span(text, *(s or (low + quoted.start(), md.trimmed(text, low + quoted.start(), b["span"]["start"])[1])))
            b["full_span"] = md.span(text, b["style"]["start"], b["full_span"]["end"])
            b["short_name"] = b["style"]["text"]
            b["reasons"].append("commented_work")
    without(citations, gone)


def join_legislation(text: str, citations: list[dict]) -> None:
    """A reprint or schedule stated right after an enactment belongs to it: being Schedule B to ..., as am ..., reprinted in ..."""
    gone = []
    for a, b in zip(citations, citations[1:], strict=False):
        if a["authority"] in ("statute", "constitution") and b["authority"] == "statute" and a["form"] == b["form"] == "full":
            gap = text[a["full_span"]["end"] : b["full_span"]["start"]]
            if len(gap) < 100 and re.fullmatch(r",?\s*(?:being Schedule \w+ to(?: the)?|constituant l['’]annexe \w+ de(?: la)?|reprinted in|reproduite? dans)\s*", gap):
                a["full_span"] = md.span(text, a["full_span"]["start"], b["full_span"]["end"])
                a["pinpoints"] += b["pinpoints"]
                gone.append(b)
    without(citations, gone)


def anchor_titles(text: str, notes: list[dict], citations: list[dict]) -> dict[int, str]:
    """For notes with an anchor in the body: the title of an enactment, or the one style of cause, in the sentence before it."""
    out = {}
    for n in notes:
        if n.get("anchor") is None:
            continue
        floor = md.sentence_floor(text, max(0, n["anchor"] - 300), n["anchor"])
        sentence = text[floor : n["anchor"]]
        titles = re.findall(r"(?:[A-ZÀ-Þ][\w'’-]*\s(?:(?:of|and|the|for|on|to)\s)*)+(?:Act|Code|Charter|Regulations?|Rules)\b", sentence)
        names = re.findall(r"[A-ZÀ-Þ][\w'’.-]*(?:\s[A-ZÀ-Þ(][\w'’.)-]*)*\s(?:v|c)\.?\s[A-ZÀ-Þ][\w'’-]*(?:\s[A-ZÀ-Þ][\w'’-]*)*", sentence)
        found = titles or names
        if len(set(found)) == 1:
            out[n["number"]] = re.sub(r"^(?:In|The|Under)\s+", "", found[0])
    return out


def join_links(text: str, citations: list[dict]) -> None:
    """An address right after a citation becomes the citation's."""
    gone = []
    for a, b in zip(citations, citations[1:], strict=False):
        if b["authority"] == "webpage" and a["form"] == "full" and a["format"] != "url" and b["span"]["start"] - a["full_span"]["end"] < 100 and re.fullmatch(r"[\s,]*(?:online:?)?\s*<?", text[a["full_span"]["end"] : b["span"]["start"]]):
            a["fields"]["url"] = b["fields"]["url"]
            a["full_span"] = md.span(text, a["full_span"]["start"], b["full_span"]["end"])
            gone.append(b)
    without(citations, gone)


HEADING = re.compile(r"(?im)^\s*(?:table|list) of authorities\s*$|^\s*authorities(?: cited)?\s*$")


def authority_list(text: str, citations: list[dict], gap: int = 320) -> set[int]:
    """Indices of citations in a list of authorities: after its heading, each at most gap characters after the one before."""
    out = set()
    for h in HEADING.finditer(text):
        at = h.end()
        for c in sorted(citations, key=lambda c: c["full_span"]["start"]):
            if c["full_span"]["start"] >= h.end() and c["full_span"]["start"] - at <= gap:
                out.add(c["index"])
                at = c["full_span"]["end"]
    return out


def note_references(text: str) -> list[dict]:
    """References to notes by number, and whether they point back or forward."""
    out = []
    pattern = re.compile(
        r"(?i)(?P<back>\bsupra,?\s+(?:foot)?n(?:ote)?s?\.?\s*|\babove,?\s+n(?:ote)?\.?\s*|\bop\.?\s?cit\.?,?\s+(?:foot)?notes?\s+|\(n\s*|\bprécitée?,?\s+note\s+)(?P<n1>\d{1,4})\b"
        r"|(?P<fwd>\binfra,?\s+(?:foot)?n(?:ote)?s?\.?\s*|\bbelow,?\s+n(?:ote)?\.?\s*)(?P<n2>\d{1,4})\b"
        r"|\b(?:voir\s+)?(?:la\s+)?note\s+(?P<n3>\d{1,4})\s+ci-(?P<fr>dessus|dessous)|\bsee\s+(?:also\s+)?footnotes?\s+(?P<n4>\d{1,4})\b"
    )
    for m in pattern.finditer(text):
        n = m["n1"] or m["n2"] or m["n3"] or m["n4"]
        way = "back" if m["n1"] or (m["fr"] or "").lower() == "dessus" else "forward" if m["n2"] or m["fr"] else "unspecified"
        out.append({"note": int(n), "direction": way, "span": md.span(text, m.start(), m.end())})
    return out


def has_citation(text: str, g: Registry = SEED, o=None) -> bool:
    """Whether a text has a core or a name of two parties."""
    if anchors(text, g, o):
        return True
    return bool(re.search(r"[A-ZÀ-Þ][\w'’.&-]*(?:\s[A-ZÀ-Þ(][\w'’.&)-]*)*\s(?:v|vs|c)\.?\s[A-ZÀ-Þ]", text))
