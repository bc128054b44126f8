"""Readings of authorities: a caption's own name, pinpoints at a selection, representatives."""

from __future__ import annotations

import re

from ..functions.keys import key
from ..schema import Options
from ..sources.registry import SEED, Registry
from . import grammar as gr
from . import metadata as md
from .find import find
from .parallel import group


def caption_style_of_cause(text: str, keys: list[str], g: Registry = SEED) -> str | None:
    """The name of a caption's own citation, if that has one of the keys."""
    citations = find(text, g, Options())
    group(text, citations, g)
    for c in citations:
        if c["form"] == "full" and key(c, g) in keys and c.get("style"):
            return re.sub(r"^(?:Citation|Référence|Indexed as)\s*:\s*", "", c["style"]["text"])
    return None


def pinpoints_at(text: str, start: int, end: int, strict: bool = False) -> list[dict]:
    """Pinpoints that a selection states, with up to three words before it for their kind; a bare number is a page unless strict."""
    head = re.search(r"(?:\S+\s+){0,3}$", text[:start])
    m = None
    for at in [head.start(), *(head.start() + x.end() for x in re.finditer(r"\s+", text[head.start() : start]))]:
        m = gr.PINPOINT.match(text, at) or m
    if m and m.end() >= start:
        return md.values(next(k for k, _ in gr.PIN_WORDS if m[k]), m["values"], m.start("values"))
    body = text[start:end]
    return [] if strict or not re.search(r"\d", body) else md.values("page", body, start)


def representative(citations: list[dict], members: list[int]) -> int | None:
    """The member that stands for a cluster: full, with a key and a format other than a docket, the first such."""
    full = [c for c in citations if c["index"] in members and c["form"] == "full"]
    return min(full, key=lambda c: (c["key"] is None, c["format"] is None, c["format"] == "docket", c["index"]))["index"] if full else None
