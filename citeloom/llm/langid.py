"""Language identification by rank-order profiles of character n-grams.

A profile is the ``PROFILE`` most frequent n-grams (1 to 4 characters, within words and with their edges)
of a language, by rank. A document's own ranks are compared with each profile by out-of-place distance:
the sum of differences in rank, ``PROFILE`` for an n-gram that the profile lacks. Counts take in all
training documents; ties in frequency are ordered by the n-gram's hash, ties in distance by language code.

Null texts and texts without a letter are ``und`` with score 0, and so is everything where nothing was
learned. Repeated rows count as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import mix
from .scratch import bound_batches

PROFILE, LONGEST = 300, 4
UNKNOWN = "und"
#: N-grams that a worker counts at once, and different ones of all languages that it remembers before it passes their counts on.
WAITING, HELD = 2_000_000, 4_000_000


@cache
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of a text's words, each with a space before and after; empty if it has no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    good = letters()[cp]
    if not good.any():
        return np.empty(0, np.uint64)
    cp = np.where(good, cp, 32)
    gap = np.concatenate(([True], ~good, [True]))
    cp = np.concatenate(([32], cp, [32])).astype(np.uint64)
    keep = ~(gap & np.concatenate(([False], gap[:-1])))  # one space of each run
    cp, gap = cp[keep], gap[keep]
    out, h, inner = [cp[~gap]], cp, None
    for n in range(2, LONGEST + 1):
        # up to three code points fit into 63 bits; longer runs are hashed and have the top bit
        h = (h[:-1] << np.uint64(21)) + cp[n - 1 :] if n < 4 else (mix(h[:-1]) + cp[n - 1 :]) | np.uint64(1 << 63)
        if n > 2:  # a space may stand at either end only
            mid = gap[n - 2 : len(gap) - 1]
            inner = mid if inner is None else inner[:-1] | mid
        out.append(h if inner is None else h[~inner])
    return np.concatenate(out)


def grams_of(gram: str) -> np.uint64:
    """The hash that stands for one n-gram, a space at either end included."""
    cp = np.frombuffer(gram.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = cp[0]
    for n in range(2, len(cp) + 1):
        h = (h << np.uint64(21)) + cp[n - 1] if n < 4 else (mix(np.array([h]))[0] + cp[n - 1]) | np.uint64(1 << 63)
    return h


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.sort(values)
    edge = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    return v[edge], np.diff(np.append(edge, len(v)))


def top(values: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent values, most frequent first, of equals the lesser first."""
    if len(values) > k:  # np.sort gave the values in order, so a stable sort by count keeps ties so
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        some = counts >= least
        values, counts = values[some], counts[some]
    return values[np.argsort(-counts, kind="stable")][:k]


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> list[tuple[str, int, int]]:
    """lang, gram, rank of every language's profile: profile rows for each language at most."""
    bound_batches(train.sparkSession)
    rows = train.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        load: dict[str, int] = {}

        def settle(lang: str) -> None:
            v, c = counted(np.concatenate(waiting.pop(lang)))
            load[lang] = 0
            if lang in held:
                both = np.concatenate((held[lang][0], v))
                order = np.argsort(both, kind="stable")
                both, n = both[order], np.concatenate((held[lang][1], c))[order]
                edge = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
                v, c = both[edge], np.add.reduceat(n, edge)
            held[lang] = (v, c)

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (v, c) in held.items():
                for i in range(0, len(v), 50_000):
                    part = v[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(c[i : i + 50_000])], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = grams(text)
                if len(g):
                    waiting.setdefault(lang, []).append(g)
                    load[lang] = load.get(lang, 0) + len(g)
                    if sum(load.values()) > WAITING:
                        for x in list(waiting):
                            settle(x)
                        if sum(len(v) for v, _ in held.values()) > HELD:
                            yield from told()
        for lang in list(waiting):
            settle(lang)
        yield from told()

    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the unsigned order of hashes, as in top()
    unsigned = F.col("gram").bitwiseXOR(F.lit(-(1 << 63)))
    some = sums.withColumn("part", F.pmod(F.col("gram"), F.lit(64)))
    for by in (("lang", "part"), ("lang",)):  # the best of each part first, so that no task sorts all of a language
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), unsigned))).where(F.col("rank") <= profile)
    return [(r[0], r[1], r[2] - 1) for r in some.select("lang", "gram", "rank").collect()]


def annotate(docs: DataFrame, profiles: list[tuple[str, int, int]], text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs, all columns, with the predicted language and its score; columns of those names are replaced."""
    langs = sorted({p[0] for p in profiles})
    table = []
    for lang in langs:
        mine = sorted((np.uint64(g & (1 << 64) - 1), r) for x, g, r in profiles if x == lang)
        table.append((np.array([m[0] for m in mine], np.uint64), np.array([m[1] for m in mine])))

    def judge(text: str | None) -> tuple[str, float]:
        g = grams(text) if text else np.empty(0, np.uint64)
        if not len(g) or not langs:
            return UNKNOWN, 0.0
        own = top(*counted(g))
        rank = np.arange(len(own))
        worst, sums = PROFILE * len(own), []
        for v, r in table:
            at = np.minimum(np.searchsorted(v, own), len(v) - 1)
            sums.append(int(np.where(v[at] == own, np.abs(r[at] - rank), PROFILE).sum()))
        best = int(np.argmin(sums))
        return langs[best], 1 - min(sums[best], worst) / worst

    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (pred, score)]
    at = keep.index(text_col)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*keep, pred, score])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def fold(docs: DataFrame, id_col: str, of: int) -> DataFrame:
    """docs with _held: whether crc32 of the id as text leaves 2; null ids are not held out."""
    return docs.withColumn("_held", F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(of)) == 2, F.lit(False)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    d = fold(docs.select("doc_id", "text", "lang"), "doc_id", 4)
    profiles = learn(d.where(~F.col("_held")))
    return annotate(d.select("doc_id", "_held", "text"), profiles).select("doc_id", F.col("_held").alias("held_out"), "lang_pred", "score")
