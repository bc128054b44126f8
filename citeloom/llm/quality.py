"""Quality rules: how much of a text lies in repeated n-grams and lines.

Words get random 64-bit values; n-grams of several lengths get rolling hashes of these in numpy. Of each
length the share of word characters inside n-grams seen before in the text is measured (overlaps count
once), of short lengths also the share inside the most frequent n-gram, and so is the share inside lines
seen before. Null texts have no words and fail. Every row stands
for itself, so repeated rows, null ids and empty tables need no care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches

#: Greatest share of the word characters in repeated n-grams, by n; chosen on labelled texts (README): the
#: published thresholds for web text, half as high from 5 on, reject no more texts labelled low, only good short ones that repeat a line.
MOST_REPEATED = {2: 0.30, 3: 0.30, 4: 0.30, 5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Greatest share in all occurrences of the most frequent n-gram (of equals the first), by n, where it occurs at least three times: published thresholds.
MOST_TOP = {2: 0.20, 3: 0.18, 4: 0.16}
LEAST_TOP = 3
MOST_LINE_CHARS = 0.20
BASE_N, BASE_SHARE, LEAST_WORDS = 8, 30, 20
SYMBOLS = b"#*$%&|<>"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads small differences over all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def rolling(values: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length n, ascending, the hashes of all runs of n values; each made from that of n - 1."""
    h, n = values, 1
    for want in sorted(lengths):
        if want > len(values):
            return
        while n < want:
            h = h[:-1] * FACTOR + values[n:]
            n += 1
        yield want, h


def repeated(h: np.ndarray) -> np.ndarray | None:
    """Where the values stand that occur twice or more; None if there are none."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return None
    at = np.searchsorted(twice, h)
    at[at == len(twice)] = 0
    return np.flatnonzero(twice[at] == h)


def later(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the places at, those whose value stands at an earlier place."""
    order = np.argsort(h[at], kind="stable")
    same = h[at][order]
    return np.sort(at[order[1:][same[1:] == same[:-1]]])


def commonest(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the places at, those of the value that stands at most of them; of equals that which comes first."""
    values, first, n = np.unique(h[at], return_index=True, return_counts=True)
    best = np.flatnonzero(n == n.max())
    return at[h[at] == values[best[np.argmin(first[best])]]]


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size places lie in a run of n that starts at one of at."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes) -> dict:
    """All figures of one text in UTF-8."""
    found = text.split()
    n = len(found)
    buf = np.frombuffer(text, np.uint8)
    solid = ~SPACE[buf]
    chars = np.concatenate(([0], np.cumsum(solid & ((buf & 0xC0) != 0x80))))
    starts = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    ends = np.flatnonzero(solid & ~np.concatenate((solid[1:], [False]))) + 1
    size = chars[ends] - chars[starts]
    total = int(chars[-1])
    seen: set[bytes] = set()
    n_dup = dup_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup += 1
            b = np.frombuffer(line, np.uint8)
            dup_chars += int(np.count_nonzero(~SPACE[b] & ((b & 0xC0) != 0x80)))
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.uint64, n)
    shares, tops, n_repeat = {k: 0.0 for k in MOST_REPEATED}, {k: 0.0 for k in MOST_TOP}, 0
    for k, h in rolling(mix(number + np.uint64(1)), [*MOST_REPEATED]):
        at = repeated(h)
        if at is None:
            break  # a longer run can't repeat where none of this length does
        if k == BASE_N:
            n_repeat = int(np.count_nonzero(covered(at, k, n)))
        again = later(h, at)
        shares[k] = float(size[covered(again, k, n)].sum()) / max(total, 1)
        if k in MOST_TOP and len(most := commonest(h, at)) >= LEAST_TOP:
            tops[k] = float(size[covered(most, k, n)].sum()) / max(total, 1)
    line_share = dup_chars / max(total, 1)
    failed = n < LEAST_WORDS or 100 * n_repeat > BASE_SHARE * n
    kept = not failed and line_share <= MOST_LINE_CHARS and all(shares[k] <= most for k, most in MOST_REPEATED.items()) and all(tops[k] <= most for k, most in MOST_TOP.items())
    return {
        "n_words": n, "word_chars": total, "n_symbols": len(text) - len(text.translate(None, SYMBOLS)), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": kept, "dup_line_chars": dup_chars, "dup_line_share": line_share, **{f"dup_{k}gram_share": shares[k] for k in MOST_REPEATED},
        **{f"top_{k}gram_share": tops[k] for k in MOST_TOP},
    }


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join([*(f"{c} long" for c in LONGS), "base_failed boolean", "kept boolean", "dup_line_chars long", "dup_line_share double", *(f"dup_{k}gram_share double" for k in MOST_REPEATED), *(f"top_{k}gram_share double" for k in MOST_TOP)])
ARROW = {c: pa.int64() for c in (*LONGS, "dup_line_chars")} | {"base_failed": pa.bool_(), "kept": pa.bool_()}


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: the id and the figures of measure()."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_t"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t) for t in b.column(1).to_pylist()]
            if got:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[c] for g in got], ARROW.get(c, pa.float64())) for c in got[0])], names=[id_col, *got[0]])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


digest = score_quality
