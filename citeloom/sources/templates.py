"""Templates of citation patterns, filled in with names of editions."""

from __future__ import annotations

import re

MOST_ROUNDS = 100


def substitute(template: str, values: dict[str, str]) -> str:
    """A template with its $names replaced; names without a value stay."""
    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: values.get(m[1] or m[2], m[0]), template)


def expand(template: str, values: dict[str, str]) -> str:
    """substitute() until nothing changes; a circle is an error."""
    for _ in range(MOST_ROUNDS):
        new = substitute(template, values)
        if new == template:
            return new
        template = new
    raise ValueError(f"invalid_request: {template[:60]!r} does not come to an end")


def variables(values: dict[str, str]) -> dict[str, str]:
    """Values and their optional twins: name_optional takes the value with a space after it, or nothing."""
    return {**values, **{f"{k}_optional": f"(?:{v} ?)?" for k, v in values.items()}}


#: Variables that templates of reports use.
BASE = variables({"volume": r"(?P<volume>\d+)", "page": r"(?P<page>\d+|_{2,}|[ivxlc]+)", "year": r"(?P<year>1[6-9]\d\d|20\d\d)", "section": r"(?P<section>\d[\w.()-]*)"})


def relaxed(name: str) -> str:
    """A name's pattern in which spaces are free and points may be missing."""
    return r"\s*".join(re.escape(w).replace(r"\.", r"\.?") for w in re.findall(r"\w+\.?|[^\w\s]", name))


def extractors(editions: list[dict], templates: tuple[str, ...] = ("$volume $reporter,? $page",)) -> list[dict]:
    """edition, pattern, short pattern, and the folded names without which neither can match."""
    out = []
    for e in editions:
        names = [e["edition"], *e.get("variations", [])]
        reporter = f"(?P<reporter>{'|'.join(sorted(map(relaxed, names), key=len, reverse=True))})"
        for t in templates:
            full = expand(t.replace(" ", r"\s+"), {**BASE, "reporter": reporter})
            short = expand(r"$volume\s+$reporter,?\s+at\s+$page", {**BASE, "reporter": reporter})
            out.append({"edition": e["edition"], "pattern": full, "short": short, "needs": [re.sub(r"\W", "", n).lower() for n in names]})
    return out


def selected(table: list[dict], text: str) -> list[dict]:
    """The extractors whose names occur in a text, spaces and points aside."""
    folded = re.sub(r"\W", "", text).lower()
    return [x for x in table if any(n in folded for n in x["needs"])]


def find(table: list[dict], text: str) -> list[dict]:
    """edition, form and groups of every match of the selected extractors, in order; longest at a place."""
    hits = []
    for x in selected(table, text):
        for form, p in (("full", x["pattern"]), ("short", x["short"])):
            hits += [{"edition": x["edition"], "form": form, "start": m.start(), "end": m.end(), **m.groupdict()} for m in re.finditer(p, text)]
    out, end = [], 0
    for h in sorted(hits, key=lambda h: (h["start"], -h["end"])):
        if h["start"] >= end:
            out.append(h)
            end = h["end"]
    return out
