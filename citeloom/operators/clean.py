"""Text cleaned step by step, each character with the range of the source that it comes from."""

from __future__ import annotations

import difflib
import html
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAGRAPHS = frozenset("p div blockquote pre ul ol table section article header footer h1 h2 h3 h4 h5 h6 figure main aside nav form fieldset dl".split())
LINES = frozenset("li tr dt dd option figcaption caption".split())
DROPPED = frozenset("script style title template".split())
ZERO_WIDTH = "​‌‍⁠﻿­"
STEPS = ("html", "html_structural", "xml", "inline_whitespace", "all_whitespace", "underscores", "zero_width")


@dataclass
class Cleaned:
    """text, and for each character of it the start and end of its source; tags of the source, in order."""

    text: str
    starts: list[int]
    ends: list[int]
    tags: list[dict] = field(default_factory=list)

    @classmethod
    def identity(cls, text: str) -> Cleaned:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def source_offset(self, at: int) -> int | None:
        if not 0 <= at <= len(self.text):
            return None
        return self.starts[at] if at < len(self.text) else (self.ends[-1] if self.ends else 0)

    def source_range(self, start: int, end: int) -> tuple[int, int] | None:
        if not 0 <= start <= end <= len(self.text):
            return None
        return (self.starts[start], self.ends[end - 1]) if start < end else (self.source_offset(start),) * 2

    def pick(self, pieces: list[tuple[int, int, str]]) -> Cleaned:
        """A text made of pieces, each of a range of this one."""
        text, starts, ends = [], [], []
        for a, b, s in pieces:
            text.append(s)
            if b - a == len(s):
                starts += self.starts[a:b]
                ends += self.ends[a:b]
            else:
                starts += [self.starts[a]] * len(s)
                ends += [self.ends[b - 1]] * len(s)
        return Cleaned("".join(text), starts, ends, self.tags)

    def replace(self, pattern: str, by: str) -> Cleaned:
        pieces, at = [], 0
        for m in re.finditer(pattern, self.text):
            pieces.append((at, m.start(), self.text[at : m.start()]))
            if by:
                pieces.append((m.start(), m.end(), by))
            at = m.end()
        pieces.append((at, len(self.text), self.text[at:]))
        return self.pick([p for p in pieces if p[0] < p[1]])


TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][\w:-]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*?)(/?)>|<[!?][^>]*>", re.S)
ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]{1,31}));")


def entity(m: re.Match) -> str | None:
    if m[3]:
        got = html.unescape(m[0])
        return got if got != m[0] else None
    n = int(m[1]) if m[1] else int(m[2], 16)
    return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else "�"


def tags_of(source: str) -> list[dict]:
    out = []
    for m in TAG.finditer(source):
        name = (m[2] or "").lower()
        kind = "other" if not name else "close" if m[1] else "self_closing" if m[4] or name in ("br", "hr", "img", "input", "meta", "link") else "open"
        out.append({"name": name, "kind": kind, "start": m.start(), "end": m.end(), "attributes": m[3] or ""})
    return out


def html_structural(source: str) -> Cleaned:
    """Tags go; blocks become one or two line ends, breaks one, cells a space; entities are read; pre keeps its spaces."""
    text: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    tags, at, pre = tags_of(source), 0, 0

    def put(s: str, a: int, b: int) -> None:
        for c in s:
            text.append(c)
            starts.append(a)
            ends.append(b)

    def newlines(n: int, a: int, b: int) -> None:
        while text and text[-1] == " ":
            text.pop(), starts.pop(), ends.pop()
        if not text:
            return
        have = 0
        while have < len(text) and text[-1 - have] == "\n":
            have += 1
        put("\n" * max(0, n - have), a, b)

    def plain(a: int, b: int) -> None:
        i = a
        while i < b:
            m = ENTITY.match(source, i, b) if source[i] == "&" else None
            got = entity(m) if m else None
            if got is not None:
                put(got, i, m.end())
                i = m.end()
                continue
            c = source[i]
            if c in " \t\n\r\f" and not pre:
                if text and text[-1] not in " \n":
                    put(" ", i, i + 1)
            else:
                put(c, i, i + 1)
            i += 1

    skip_to = -1
    for t in tags:
        if t["start"] < skip_to:
            continue
        plain(at, t["start"])
        at, name = t["end"], t["name"]
        if t["kind"] == "open" and name in DROPPED:
            close = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            skip_to = at = close.end() if close else len(source)
            continue
        if name == "pre":
            pre += 1 if t["kind"] == "open" else -1 if t["kind"] == "close" and pre else 0
        if name == "br":
            while text and text[-1] == " ":
                text.pop(), starts.pop(), ends.pop()
            put("\n", t["start"], t["end"])
        elif name in PARAGRAPHS:
            newlines(2, t["start"], t["end"])
        elif name in LINES:
            newlines(1, t["start"], t["end"])
        elif name in ("td", "th") and t["kind"] == "close" and text and text[-1] not in " \n":
            put(" ", t["start"], t["end"])
    plain(at, len(source))
    return Cleaned("".join(text), starts, ends, tags)


def html_nodes(source: str) -> Cleaned:
    """Text nodes that are not blank, outside style, link, head and page numbers, joined by a space; as it is where there is no tag."""
    tags = [t for t in tags_of(source) if t["name"]]
    if not tags:
        c = Cleaned.identity(source)
        return c
    out = Cleaned("", [], [], tags_of(source))
    skipped: list[str] = []
    at, nodes = 0, []
    for t in [*tags_of(source), {"name": "", "kind": "end", "start": len(source), "end": len(source), "attributes": ""}]:
        if at < t["start"] and not skipped:
            nodes.append((at, t["start"]))
        if t["kind"] == "open" and (t["name"] in ("style", "link", "head", "page-number", "script") or "star-pagination" in t["attributes"]):
            skipped.append(t["name"])
        elif t["kind"] == "close" and skipped and skipped[-1] == t["name"]:
            skipped.pop()
        at = max(at, t["end"])
    text, starts, ends = [], [], []
    for a, b in nodes:
        if not source[a:b].strip():
            continue
        if text:
            text.append(" "), starts.append(a), ends.append(a)
        i = a
        while i < b:
            m = ENTITY.match(source, i, b) if source[i] == "&" else None
            got, j = (entity(m), m.end()) if m and entity(m) is not None else (source[i], i + 1)
            for c in got:
                text.append(c), starts.append(i), ends.append(j)
            i = j
    out.text, out.starts, out.ends = "".join(text), starts, ends
    return out


def clean(source: str, steps: list[str]) -> Cleaned:
    """A text after the steps, in order; an unknown step is an error."""
    c = Cleaned.identity(source)
    for step in steps:
        if step not in STEPS:
            raise ValueError(f"invalid_request: unknown step {step!r}")
        if step in ("html", "html_structural"):
            new = (html_nodes if step == "html" else html_structural)(c.text)
            new.starts, new.ends = [c.starts[a] if a < len(c.starts) else len(source) for a in new.starts], [c.ends[b - 1] if b else 0 for b in new.ends]
            c = new
        elif step == "xml":
            c = c.replace(r"\A<\?xml[^\n]*?\?>", "")
        elif step == "inline_whitespace":
            c = c.replace(r"[^\S\n]+", " ")
        elif step == "all_whitespace":
            c = c.replace(r"[\s​]+", " ")
        elif step == "underscores":
            c = c.replace(r"__+", "")
        else:
            c = c.replace(f"[{ZERO_WIDTH}]+", "")
    return c


def clean_column(text: Column, steps: list[str]) -> Column:
    """The text after the steps that are plain replacements, without offsets; html steps need clean()."""
    rules = {"xml": (r"^<\?xml[^\n]*?\?>", ""), "inline_whitespace": (r"[\s\x{00a0}&&[^\n]]+", " "), "all_whitespace": (r"[\s\x{00a0}\x{200b}\p{Z}]+", " "), "underscores": (r"__+", ""), "zero_width": (f"[{ZERO_WIDTH}]+", "")}
    for s in steps:
        if s not in rules:
            raise ValueError(f"invalid_request: {s!r} is no plain replacement")
        text = F.regexp_replace(text, *rules[s])
    return text


def placeholder_markup(source: str) -> str:
    """A source of the same length with X for the characters of tags."""
    return TAG.sub(lambda m: "X" * len(m[0]), source)


def align(source: str, text: str) -> Cleaned:
    """The map of a text that a caller has cleaned, from the differences to its source."""
    starts, ends = [0] * len(text), [0] * len(text)
    at = 0
    for tag, a, b, c, d in difflib.SequenceMatcher(None, source, text, autojunk=False).get_opcodes():
        for k in range(c, d):
            if tag == "equal":
                starts[k], ends[k] = a + k - c, a + k - c + 1
            else:
                starts[k], ends[k] = a, max(b, a)
        at = b
    assert at <= len(source)
    return Cleaned(text, starts, ends, tags_of(source))
