"""Parallel citations of one decision: neighbours joined into groups."""

from __future__ import annotations

import re

from ..functions.keys import key
from ..functions.text import fold
from ..sources.registry import SEED, Registry

#: Kinds of a report in order of preference.
RANKS = {"official": 1, "general": 2, "specialty": 3, "unknown": 3, "can_lii": 4, "database": 5, "digest": 6}


def case_like(c: dict) -> bool:
    return c["form"] == "full" and c["authority"] == "case" and c["format"] in ("neutral", "reporter", "can_lii", "database", "numberless")


def distinct(a: dict, b: dict, g: Registry = SEED) -> bool:
    """Whether two citations are certainly of different decisions."""
    if a["format"] == b["format"] and a["format"] in ("neutral", "can_lii") and key(a, g) != key(b, g):
        return True
    if a.get("court") and b.get("court") and a["court"]["id"] != b["court"]["id"]:
        return True
    if a["format"] == b["format"] == "reporter" and fold(a["fields"].get("reporter_canonical") or a["fields"]["reporter"]) == fold(b["fields"].get("reporter_canonical") or b["fields"]["reporter"]):
        if (a["fields"].get("volume"), a["fields"].get("page")) != (b["fields"].get("volume"), b["fields"].get("page")):
            return True
    ya, yb = a["fields"].get("year"), b["fields"].get("year")
    return bool(ya and yb and abs(int(ya) - int(yb)) > 2)


def joinable(text: str, members: list[dict], c: dict, g: Registry) -> bool:
    last = members[-1]
    gap = text[last["full_span"]["end"] : c["full_span"]["start"]]
    if not case_like(last) or not case_like(c) or c.get("style") or c.get("signal"):
        return False
    return bool(re.fullmatch(r"[\s,]*", gap)) and "," in gap and not any(distinct(m, c, g) for m in members)


def group(text: str, citations: list[dict], g: Registry = SEED) -> None:
    """Set parallel_group (the index of a group's first member) and share what one member knows with the others."""
    run: list[dict] = []

    def close() -> None:
        if len(run) > 1:
            for c in run:
                c["parallel_group"] = run[0]["index"]
            for what in ("court", "jurisdiction"):
                known = next((c[what] for c in run if c.get(what)), None)
                for c in run:
                    c[what] = c.get(what) or known
            y = next((c["fields"]["year"] for c in run if c["fields"].get("year")), None)
            for c in run:
                if y and not c["fields"].get("year"):
                    c["fields"]["year"] = y
                for what in ("parties", "style", "short_name", "explicit_short_name"):
                    if what == "explicit_short_name":
                        c[what] = c.get(what) or next((x[what] for x in run if x.get(what)), None)
                    else:
                        c[what] = c.get(what) or run[0].get(what)

    for c in sorted(citations, key=lambda c: (c["span"]["start"], c["span"]["end"])):
        if run and joinable(text, run, c, g):
            run.append(c)
        else:
            close()
            run = [c]
    close()


def members(citations: list[dict], index: int) -> list[int]:
    c = next(c for c in citations if c["index"] == index)
    if c.get("parallel_group") is None:
        return [index]
    return [x["index"] for x in citations if x.get("parallel_group") == c["parallel_group"]]


def rank(c: dict, g: Registry = SEED) -> int:
    if c["format"] in ("neutral", "numberless"):
        return 0
    if c["format"] in ("can_lii", "database"):
        return RANKS[c["format"]]
    rows = g.by_reporter.get(fold(c["fields"].get("reporter")), [])
    return RANKS.get(rows[0]["kind"], 3) if rows else RANKS["unknown"]


def preferred(citations: list[dict], index: int, g: Registry = SEED) -> int:
    by = {c["index"]: c for c in citations}
    return min(members(citations, index), key=lambda i: (rank(by[i], g), i))
