"""Antecedents of back references, and clusters of citations of one authority.

Resolution reads a document's citations in the order of its notes. It abstains wherever more than one
authority could be meant; an unresolved reference is a value of the state too, so that an ibid after it
stays unresolved.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

from ..functions.keys import key
from ..functions.text import edits, fold
from ..functions.text import plain as _plain
from ..sources.registry import SEED, Registry
from .find import is_crown


def representative(c: dict) -> int:
    return c["parallel_group"] if c.get("parallel_group") is not None else c["index"]


def cites_record(c: dict) -> bool:
    return any(p["kind"] == "record" for p in c.get("parentheticals") or ())


def reference_name(c: dict) -> str | None:
    """The name that a back reference gives: its short name, or what stands before its token."""
    if c.get("short_name"):
        return c["short_name"]
    text = (c.get("full_span") or c["span"])["text"]
    m = re.match(r"(?P<n>.+?),?\s*(?:\bsupra\b|\babove\b|\(n\s*\d+\)|\bprécité)", text)
    return m["n"].strip() or None if m and m["n"].strip() else None


@lru_cache(maxsize=100_000)
def plain(text: str | None) -> str:
    return _plain(text)


def contains_words(whole: str, part: str) -> bool:
    return bool(part) and f" {part} " in f" {whole} "


def names(c: dict) -> list[str]:
    p = c.get("parties") or {}
    style = (c.get("style") or {}).get("text") or c.get("short_name")
    return [plain(n) for n in (style, p.get("plaintiff"), p.get("defendant")) if n]


class Pool:
    """Citations that a reference may mean, found by the names they have."""

    def __init__(self, citations: list[dict] = ()):
        self.all: list[dict] = []
        self.named = self.worded = 0  # of self.all those that are under their names, and under their words
        self.stated: dict[str, list[dict]] = {}
        self.whole: dict[str, list[dict]] = {}
        self.words: dict[str, list[dict]] = {}
        self.volumes: dict[str | None, list[dict]] = {}
        self.of: dict[int, list[dict]] = {}
        for c in citations:
            self.add(c)

    def add(self, c: dict) -> None:
        self.all.append(c)
        self.of.setdefault(representative(c), []).append(c)
        if c["format"] == "reporter":
            self.volumes.setdefault(c["fields"].get("volume"), []).append(c)

    def by_names(self) -> None:
        """Put what came since the last question under its names."""
        for c in self.all[self.named :]:
            if c.get("explicit_short_name"):
                self.stated.setdefault(plain(c["explicit_short_name"]), []).append(c)
            style = plain((c.get("style") or {}).get("text"))
            for n in {style, *(plain(x) for x in (c.get("parties") or {}).values() if x)}:
                self.whole.setdefault(n, []).append(c)
        self.named = len(self.all)

    def by_words(self) -> dict[str, list[dict]]:
        """Citations by the words of their names, with what came since the last question."""
        for c in self.all[self.worded :]:
            for w in {w for n in names(c) for w in n.split()}:
                self.words.setdefault(w, []).append(c)
        self.worded = len(self.all)
        return self.words

    def containing(self, name: str) -> list[dict]:
        """Those one of whose names has the words of a name, in order: looked for at the rarest of its words."""
        words = self.by_words()
        rarest = min((words.get(w, []) for w in name.split()), key=len, default=[])
        return [c for c in rarest if any(contains_words(x, name) for x in names(c))]


def near_name(name: str, pool: Pool) -> tuple[int | None, str]:
    """The one authority a word of whose names differs from a word of a name by one letter, in words of five letters or more."""
    words = [w for w in plain(name).split() if len(w) >= 5]
    found = {representative(c) for x, cs in pool.by_words().items() if any(abs(len(x) - len(w)) <= 1 and len(x) >= 5 and edits(x, w, 1) <= 1 for w in words) for c in cs}
    return (found.pop(), "near_name") if len(found) == 1 else (None, "ambiguous_name" if found else "no_match")


def by_name(name: str | None, pool: Pool | list[dict]) -> tuple[int | None, str]:
    """The one authority of a pool that a name means: by its stated short form, else by a whole name, else by words of its style."""
    if not name:
        return None, "no_hint"
    n = plain(name)
    if not n or is_crown(name):
        return None, "no_match"
    pool = pool if isinstance(pool, Pool) else Pool(pool)
    pool.by_names()
    stated = pool.stated.get(n, [])
    for tier in ("stated", "whole", "words"):
        hits = stated if tier == "stated" else pool.whole.get(n, []) if tier == "whole" else pool.containing(n)
        found = {representative(c) for c in hits}
        if tier != "stated" and len(found) > 1 and not stated:
            # several citations of one decision are no ambiguity
            keys = {key(c) for r in found for c in pool.of[r]}
            if len(keys) == 1 and None not in keys:
                return min(found), "name_only"
        if len(found) == 1:
            return found.pop(), "name_only"
        if found:
            return None, "ambiguous_name"
    return None, "no_match"


def locator_fits(reference: dict, target: dict, extents: dict | None = None) -> bool:
    """Whether a reference's pinpoints can be of a target: paragraphs of no enactment, pages within a report."""
    for p in reference["pinpoints"]:
        if p["kind"] in ("section", "article", "rule", "schedule") and target["authority"] == "case":
            return False
        if p["kind"] == "paragraph" and target["authority"] in ("statute", "constitution"):
            return False
        if p["kind"] == "page" and target["format"] == "reporter" and p["first"].isdecimal() and (target["fields"].get("page") or "").isdecimal():
            first = int(target["fields"]["page"])
            last = (extents or {}).get(target.get("key"), {}).get("last_page") or first + 350
            if not first <= int(p["first"]) <= last:
                return False
        if p["kind"] == "paragraph" and p["first"].isdecimal():
            most = (extents or {}).get(target.get("key"), {}).get("paragraphs")
            if most and int(p["first"]) > most:
                return False
    return True


def short(c: dict, pool: Pool, g: Registry) -> tuple[int | None, str]:
    """A short form: the earlier report of its reporter and volume whose page is not beyond its own; else by name."""
    f = c["fields"]
    ids = {r["id"] for r in g.by_reporter.get(fold(f.get("reporter")), [])} or {fold(f.get("reporter"))}
    found = []
    for t in pool.volumes.get(f.get("volume"), []):
        tf = t["fields"]
        if ({r["id"] for r in g.by_reporter.get(fold(tf.get("reporter")), [])} or {fold(tf.get("reporter"))}) & ids:
            if (tf.get("page") or "").isdecimal() and (f.get("page") or "").isdecimal() and int(tf["page"]) <= int(f["page"]):
                found.append(t)
    got = {representative(t) for t in found}
    if len(got) == 1:
        return got.pop(), "short_reporter"
    if got:
        target, _ = by_name(c.get("short_name"), found)
        return (target, "short_name") if target is not None else (None, "short_ambiguous")
    return None, "short_no_match"


def resolve_rows(citations: list[dict], notes: list[dict] | None = None, g: Registry = SEED, extents: dict | None = None, check_locators: bool = False, linking: str = "safe") -> list[dict]:
    """index, antecedent and reason of every citation that is not full, in order of index.

    linking: "aggressive" also links names that are off by a letter, a name against the note that is stated,
    and a note number by the shift that other references of the document show.
    """
    bold = linking == "aggressive"
    shifts: list[tuple[int, int]] = []
    note_numbers: dict[int, int] = {}
    notes = sorted(notes or [], key=lambda n: (n.get("sequence") or 0, n["number"], n["start"]))
    # notes in order of their place in the text; of overlapping ones the first in reading order holds a citation
    ranges = sorted((n["start"], n["end"], i) for i, n in enumerate(notes))
    starts, widest = [r[0] for r in ranges], max((e - s for s, e, _ in ranges), default=0)
    ends = sorted((n["end"], i) for i, n in enumerate(notes))
    upto, most = [e for e, _ in ends], list(accumulate((i for _, i in ends), max))

    def note_of(at: int) -> int | None:
        found, k = [], bisect_right(starts, at) - 1
        while k >= 0 and ranges[k][0] > at - widest - 1:
            if ranges[k][0] <= at < ranges[k][1]:
                found.append(ranges[k][2])
            k -= 1
        return min(found, default=None)

    place = {c["index"]: note_of(c["span"]["start"]) for c in citations}

    def order(c: dict) -> tuple:
        i = place[c["index"]]
        if i is not None:
            return i, 0, c["span"]["start"]
        k = bisect_right(upto, c["span"]["start"])
        return (most[k - 1] if k else -1), 1, c["span"]["start"]

    by = {c["index"]: c for c in citations}
    ordered = sorted(citations, key=order)
    done: dict[int, tuple[int | None, str]] = {}
    targets: dict[int, list[int | None]] = {i: [] for i in range(len(notes))}
    pool = Pool()
    at_number = {(n["number"], n.get("sequence") or 0): j for j, n in reversed(list(enumerate(notes)))}
    for k, c in enumerate(ordered):
        i, form = place[c["index"]], c["form"]
        target: int | None = None
        if form == "full":
            target = None if cites_record(c) else representative(c)
            if target is not None:
                pool.add(c)
        else:
            if form == "unknown":
                target, reason = None, "unknown_form"
            elif form == "ibid":
                prev = ordered[k - 1] if k else None
                if i is None or (prev is not None and place[prev["index"]] == i):
                    if prev is None:
                        target, reason = None, "ibid_no_previous"
                    else:
                        target = (None if cites_record(prev) else representative(prev)) if prev["form"] == "full" else done[prev["index"]][0]
                        reason = "ibid_previous" if target is not None else "ibid_after_unresolved"
                else:
                    n = notes[i]
                    last = at_number.get((n["number"] - 1, n.get("sequence") or 0))
                    got = targets[last] if last is not None else []
                    if not got:
                        target, reason = None, "ibid_no_previous"
                    elif None in got:
                        target, reason = None, "ibid_after_unresolved"
                    elif len(set(got)) > 1:
                        target, reason = None, "ibid_after_multiple"
                    else:
                        target, reason = got[0], "ibid_previous_note"
                if target is not None and not us_page_fits(c, by[target]):
                    target, reason = None, "ibid_page_conflict"
            elif form == "supra":
                target, reason = _supra(c, i, notes, targets, by, pool)
                number, name = c["fields"].get("note"), reference_name(c)
                if bold and target is None and reason in ("note_name_conflict", "note_out_of_range", "note_without_authority"):
                    if name:
                        target, told = by_name(name, pool)
                        if target is not None:
                            reason = "name_over_note"
                            if target in note_numbers:
                                shifts.append((number, note_numbers[target]))
                    elif (d := drift(shifts)) is not None:
                        moved = c | {"fields": c["fields"] | {"note": number + d}}
                        target, told = _supra(moved, i, notes, targets, by, pool)
                        reason = "renumbered" if target is not None else reason
                if bold and target is None and name and reason in ("no_match", "note_name_conflict"):
                    target, told = near_name(name, pool)
                    reason = told if target is not None else reason
            elif form == "short":
                target, reason = short(c, pool, g)
                if target is None and reason == "short_no_match" and c.get("short_name"):
                    named, _ = by_name(c["short_name"], pool)
                    target, reason = (named, "short_name") if named is not None else (None, "short_no_match")
            else:
                target, reason = by_name(c.get("short_name") or c["span"]["text"], pool)
            if target is not None and check_locators and not locator_fits(c, by[target], extents):
                target, reason = None, "locator_conflict"
            done[c["index"]] = (target, reason)
        if i is not None:
            targets[i].append(target)
            if form == "full" and target is not None:
                note_numbers.setdefault(target, notes[i]["number"])
    return [{"index": x, "antecedent": t, "reason": r} for x, (t, r) in sorted(done.items())]


def us_page_fits(c: dict, target: dict) -> bool:
    """Whether the page of an Id. can be in the American report that it would refer to: not before the report's first page."""
    first = (target["fields"].get("page") or "") if target["format"] == "reporter" and (target.get("jurisdiction") or "").startswith("us") else ""
    pages = [p["first"] for p in c["pinpoints"] if p["kind"] == "page" and p["first"].isdecimal()]
    return not first.isdecimal() or not pages or min(map(int, pages)) >= int(first)


def _supra(c: dict, i: int | None, notes: list[dict], targets: dict, by: dict, pool: Pool) -> tuple[int | None, str]:
    name, number = reference_name(c), c["fields"].get("note")
    if number is None or not notes:
        return by_name(name, pool)
    here = (notes[i].get("sequence") or 0) if i is not None else None
    places = [j for j, n in enumerate(notes) if n["number"] == number and (here is None or (n.get("sequence") or 0) == here)]
    if not places:
        return None, "note_out_of_range"
    if len(places) > 1:
        return None, "ambiguous_note"
    got = list(dict.fromkeys(t for t in targets[places[0]] if t is not None))
    if not got:
        return None, "note_without_authority"
    if name:
        inside = [t for r in got for t in pool.of.get(r, [])]
        target, reason = by_name(name, inside)
        if target is not None:
            return target, "note_and_name"
        return None, "ambiguous_note" if reason == "ambiguous_name" else "note_name_conflict"
    return (got[0], "note_only") if len(got) == 1 else (None, "ambiguous_note")


def drift(resolved: list[tuple[int, int]]) -> int | None:
    """How far note numbers are off: the most common difference of (stated, actual) that half and at least two share; of equals the least."""
    if not resolved:
        return None
    counts: dict[int, int] = {}
    for stated, actual in resolved:
        counts[actual - stated] = counts.get(actual - stated, 0) + 1
    d, n = min(counts.items(), key=lambda x: (-x[1], abs(x[0]), x[0]))
    return d if n >= 2 and 2 * n >= len(resolved) else None


def authorities(citations: list[dict], g: Registry = SEED) -> list[list[int]]:
    """Clusters of indices by parallel group, equal key and antecedent, each and all in order; what is unresolved is in none."""
    root = {c["index"]: c["index"] for c in citations}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    def join(a: int, b: int) -> None:
        a, b = sorted((top(a), top(b)))
        root[b] = a

    keys: dict[str, int] = {}
    inside = set()
    for c in citations:
        if c["form"] == "full":
            inside.add(c["index"])
            k = c.get("key") or key(c, g)
            if k:
                join(c["index"], keys.setdefault(k, c["index"]))
            if c.get("parallel_group") is not None and c["parallel_group"] in root:
                join(c["index"], c["parallel_group"])
        elif c.get("antecedent") is not None and c["antecedent"] in root:
            inside.add(c["index"])
            join(c["index"], c["antecedent"])
    groups: dict[int, list[int]] = {}
    for i in sorted(inside):
        groups.setdefault(top(i), []).append(i)
    return sorted(groups.values())


def source_links(groups: list[tuple[int, tuple[str, ...]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Links of citations whose sets of alias keys are equal; those whose sets only overlap are in conflict."""
    links, conflicts, by = [], [], {}
    for i, ks in groups:
        s = frozenset(ks)
        if s in by:
            links.append((by[s], i))
        else:
            if any(s & t for t in by):
                conflicts.append(i)
            by[s] = i
    return links, conflicts
