"""Whether an excerpt of a decision is prose or a list of authorities, and cues of citations in layouts."""

from __future__ import annotations

import re

from ..functions.text import utf16_length
from ..sources.registry import SEED
from .find import anchors

#: Function words by which prose is told.
FUNCTION_WORDS = frozenset("the of and to in that was is it he she they were be been by with for on as at from had has have which this not or an but their his her its whether would could should may must".split())


def classify(text: str, o, g=SEED) -> dict:
    """kind: insufficient, authority_list, prose or mixed; with coverage, runs and function words."""
    units = utf16_length(text)
    spans = merged(text, [(c["span"]["start"], c["span"]["end"]) for c in anchors(text, g, o)])
    coverage = sum(b - a for a, b in spans) / max(units, 1)
    words = sum(w.lower() in FUNCTION_WORDS for w in re.findall(r"[A-Za-z]+", text))
    out = {"coverage": coverage, "runs": len(spans), "function_words": words}
    if units < 60:
        return {"kind": "insufficient", **out}
    if (len(spans) >= 3 and words < 4 * len(spans)) or (coverage > 0.5 and words < 8):
        return {"kind": "authority_list", **out}
    window = re.search(r"(?:\b[a-z]+\b\W+){4,}", text)
    if not window or len(window[0]) < 20:
        return {"kind": "authority_list" if spans else "insufficient", **out}
    return {"kind": "prose" if coverage <= 0.15 and len(spans) <= 2 else "mixed", **out}


def merged(text: str, spans: list[tuple[int, int]], gap: int = 6) -> list[tuple[int, int]]:
    """Spans in order, those with at most a few characters of glue between them as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a - out[-1][1] <= gap and re.fullmatch(r"[\s,;()&]*|\s*and\s*", text[out[-1][1] : a]):
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


CUE = re.compile(r"\b(?:[Ii]bid|[Ss]upra|[Ii]nfra|[Ii]d\.|op\.? cit|loc\.? cit)\b|\[\d{4}\]\s+\d|\b\d{4}\s+[A-Z]{2,6}\s+\d|\b\d+\s+(?:U\.S\.|F\.\dd|DLR|SCR)\b|§|\bv\.?\s+[A-Z]|\bc\s+[A-Z]-?\d|\b(?:RSC|SC|SOR|CQLR|RSO)\b")
SIGNAL_CUE = re.compile(r"^\s*(?:see|cf|but see|see also|voir|contra|accord|e\.g\.|compare)\b", re.I)
CONTINUATION = re.compile(r"^\s*(?:\(?\d{4}\)?\s|at\s+(?:para|p|\d)|paras?\.?\s|\[\d|\d+\s+[A-Z]|[A-Z]{2,6}\s+\d|,)")
COUNTER = re.compile(r"^(?:para(?:graph)?s?|pages?|sections?|notes?|footnotes?|articles?|rules?|chapters?|volumes?)\.?$", re.I)


def has_cue(text: str) -> bool:
    return bool(CUE.search(text))


def has_signal(text: str) -> bool:
    return bool(SIGNAL_CUE.search(text))


def is_continuation(text: str) -> bool:
    return bool(CONTINUATION.match(text))


def is_counter_noun(word: str) -> bool:
    return bool(COUNTER.match(word))


def heading_plausible(text: str) -> bool:
    """Whether a line can be a heading: short, without citation, not ended like a sentence."""
    t = text.strip()
    return bool(t) and len(t) <= 120 and not has_cue(t) and not re.search(r"[.;:,]$", t) and t[0].isupper()


def protected_spans(text: str, o, g=SEED) -> list[tuple[int, int]]:
    """Ranges of digits that belong to citations, so that a layout reads no note markers in them."""
    return [(c["span"]["start"] + m.start(), c["span"]["start"] + m.end()) for c in anchors(text, g, o) for m in re.finditer(r"\d+", c["span"]["text"])]


def matches_scr_header(text: str) -> bool:
    return bool(re.match(r"\s*\[\d{4}\]\s+\d\s+(?:S\.?C\.?R\.?|R\.?C\.?S\.?)(?:\s+\d+)?\s*$", text))
