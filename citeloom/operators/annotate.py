"""Annotations put around ranges of a text, or around what they come from in its source."""

from __future__ import annotations

from .clean import Cleaned


def accepted(length: int, annotations: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Those with a range inside the text that overlap none before them (by start, longest first)."""
    out, end = [], 0
    for a in sorted(annotations, key=lambda a: (a[0], -a[1])):
        if 0 <= a[0] < a[1] <= length and a[0] >= end:
            out.append(a)
            end = a[1]
    return out


def clamped(length: int, annotations: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Annotations in order; one that begins before the end of the last begins there, or goes if nothing is left of it."""
    out, end = [], 0
    for a, b, x, y in sorted(annotations, key=lambda a: (a[0], a[1])):
        a, b = max(a, end, 0), min(b, length)
        if a < b:
            out.append((a, b, x, y))
            end = b
    return out


def insert(text: str, annotations: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for a, b, before, after in annotations:
        out += [text[at:a], before, text[a:b], after]
        at = b
    return "".join([*out, text[at:]])


def annotate(text: str, annotations: list[tuple[int, int, str, str]]) -> str:
    return insert(text, accepted(len(text), annotations))


def render(text: str, annotations: list[tuple[int, int, str, str]]) -> str:
    return insert(text, clamped(len(text), annotations))


def unbalanced(tags: list[dict]) -> bool:
    """Whether a run of tags closes what it did not open, or opens what it does not close."""
    open_: list[str] = []
    for t in tags:
        if t["kind"] == "open":
            open_.append(t["name"])
        elif t["kind"] == "close":
            if not open_ or open_[-1] != t["name"]:
                return True
            open_.pop()
    return bool(open_)


def annotate_source(source: str, cleaned: Cleaned, annotations: list[tuple[int, int, str, str]], mode: str = "unchecked", policy=accepted) -> str:
    """Annotations of a cleaned text put into its source; mode says what becomes of a range that cuts elements: unchecked, skip or wrap."""
    out = []
    for a, b, before, after in policy(len(cleaned.text), annotations):
        s, e = cleaned.source_range(a, b)
        inside = [t for t in cleaned.tags if s <= t["start"] and t["end"] <= e]
        if mode == "unchecked" or not unbalanced(inside):
            out.append((s, e, before, after))
        elif mode == "skip":
            grown = recover(source, cleaned.tags, s, e)
            if grown:
                out.append((*grown, before, after))
        else:
            at = s
            for t in [*inside, {"start": e, "end": e}]:
                if source[at : t["start"]]:
                    out.append((at, t["start"], before, after))
                at = t["end"]
    return insert(source, out)


def recover(source: str, tags: list[dict], start: int, end: int, reach: int = 10) -> tuple[int, int] | None:
    """A range grown or shrunk by one tag of style at an edge, if that balances it."""
    near = [t for t in tags if t["name"] in ("i", "b", "em", "strong", "u", "span", "a")]
    options = [(t["start"], end) for t in near if t["end"] == start or (t["kind"] == "open" and start - reach <= t["start"] < start and not source[t["end"] : start].strip())]
    options += [(start, t["end"]) for t in near if t["start"] >= end and t["kind"] == "close" and t["start"] - end <= reach and not source[end : t["start"]].strip()]
    options += [(t["end"], end) for t in near if t["start"] == start] + [(start, t["start"]) for t in near if t["end"] == end]
    for s, e in options:
        if s < e and not unbalanced([t for t in tags if s <= t["start"] and t["end"] <= e]):
            return s, e
    return None


def template(pattern: str, c: dict) -> str:
    """A pattern with {index} {key} {form} {authority} {url} of a citation."""
    for name in ("index", "key", "form", "authority", "url"):
        pattern = pattern.replace("{" + name + "}", "" if c.get(name) is None else str(c[name]))
    return pattern


def citation_annotations(citations: list[dict], before: str, after: str, extent: str = "core", forms: tuple[str, ...] = ("full",)) -> list[tuple[int, int, str, str]]:
    which = "span" if extent == "core" else "full_span"
    return [(c[which]["start"], c[which]["end"], template(before, c), template(after, c)) for c in citations if c["form"] in forms]
