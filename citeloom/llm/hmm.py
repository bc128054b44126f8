"""A hidden Markov language model over words, trained and scored across partitions.

A word is emitted in two steps: a state emits the word's class, and the class emits the word, by counts over
all training documents with one unseen word added. The ``FREQUENT`` commonest words of the training texts are
classes of their own, so that states emit them directly; every other word backs off to a class of its ending
and length, hashed to ``ENDINGS``. So latent states carry a bounded table, counts of all words stay
distributed, and the probability of a text is exact: P(classes), by the scaled forward recursion, times
P(words | classes).

1. Texts are read once into two tables in the shared folder: the words of each block of texts once, with their
   counts, and the blocks, each text as numbers of these words.
2. Words are counted over the corpus; the commonest become classes.
3. Baum-Welch: each task adds up expected counts of its blocks; they are summed, as whole numbers of
   1 / UNIT so that the order of sums changes nothing, and a table of STATES * CLASSES numbers goes to the driver.
   Rounds over all training texts go on until one gains less than ``TOLERANCE`` a token. Where there is much
   text, the model they begin with has been trained in the same way on samples of texts, each some times as
   large as the one before, which saves rounds over all.
4. Each block meets the counts of its own words again for scoring.

Null and empty texts are one end token. Null ids are in the training part. Repeated rows count as often
as they occur. With no training document every token is unknown. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import fold
from .scratch import bound_batches, drop, give_back, giving_back, join_counted, make_dir, materialize, new_path
from .tokens import values

STATES, SEED = 32, 7
#: Classes: the end of a text, the commonest words, and the endings of all others.
FREQUENT, ENDINGS = 2048, 2048
CLASSES = 1 + FREQUENT + ENDINGS
#: Training ends when a round raises the log10 likelihood of a training token by less.
TOLERANCE = 0.002
#: Tokens of the sample that the first model is trained on, the least rows it is dealt to, and how many times as large the next sample is.
SAMPLE, PARTS, NEXT = 1 << 20, 8, 4
#: UTF-8 bytes of text in a block, beside its last text.
BLOCK_BYTES = 32 << 20
#: Tokens of texts whose recursions go on at once, and of the steps that are held.
LOAD, HELD = 400_000, 500_000
#: Rows of a part of the backward recursion and of the products that sum expected counts; such sums are added up in double precision.
MOVES = 1 << 13
UNIT = float(1 << 14)
END = 0


def ending(word: bytes) -> int:
    """The class of a word that is none of the commonest, from 0 on: by its last three bytes and its length up to eight."""
    return xxhash.xxh32_intdigest(word[-3:] + bytes([min(len(word), 8)])) % ENDINGS


word_hash = xxhash.xxh3_64_intdigest


def endings_of(words: pa.Array) -> np.ndarray:
    """ending() of each word of a binary array, called once for each different last bytes and length."""
    if not len(words):
        return np.empty(0, np.uint16)
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, n = np.frombuffer(words.buffers()[2], np.uint8), np.diff(edges)
    key = np.minimum(n, 8)
    for k in (1, 2, 3):
        key |= np.where(n >= k, data[np.maximum(edges[1:] - k, 0)], 0).astype(np.int64) << 8 * k
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    return np.array([ending(w) for w in words.take(pa.array(first)).to_pylist()], np.uint16)[back]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary) one after the other, A-Z in lower case, and how many each text has."""
    # these functions go by bytes, whatever the bytes are
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))
    flat, edges = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full).view(pa.binary()), np.diff(upto[edges - edges[0]]).astype(np.int32)


def number_words(parts: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers, in the order in which they occur first, and the different words in that order."""
    if sum(p.nbytes for p in parts) < 1 << 31:  # as one array, whose words are looked up once
        told = pa.concat_arrays([*parts, pa.array([], pa.binary())]).dictionary_encode()
        return told.indices.to_numpy().astype(np.uint32), told.dictionary
    told = pa.chunked_array(parts, pa.binary()).dictionary_encode().unify_dictionaries()
    return np.concatenate([c.indices.to_numpy() for c in told.chunks]).astype(np.uint32), told.chunk(0).dictionary


class Classes:
    """Classes of a block's words by their hashes and endings: 1 to FREQUENT by place among the commonest words, above by ending."""

    def __init__(self, common: list[bytes]):
        hashes = np.array([word_hash(w) for w in common], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], (1 + order).astype(np.uint16)

    def __call__(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = (endings + np.uint16(1 + FREQUENT)).astype(np.uint16)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            same = self.hashes[at] == hashes
            out[same] = self.ids[at[same]]
        return out


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def read_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "_held") -> tuple[DataFrame, DataFrame]:
    """Two written tables: blocks (block, ids, held, lengths, numbers, hashes, endings, tokens: those of its training texts, with ends) and their words (block, place, word, ending, tf: times in its training texts)."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{held_col}`").alias("_held"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_t"))
    id_kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        id_type = None
        ids, held, lengths, parts, load = [], [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            block, each = first + made, np.concatenate(lengths)
            flat, words = number_words(parts)
            n = len(words)
            train = np.repeat(~np.array(held, bool), each)
            tf = np.bincount(flat[train], minlength=n) if n else np.empty(0, np.int64)
            hashes, ends = np.fromiter(map(word_hash, values(words)), np.uint64, n), endings_of(words)
            names = ["kind", "block", "place", "word", "ending", "tf", "ids", "held", "lengths", "numbers", "hashes", "endings", "tokens"]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), *[pa.binary()] * 4, pa.int64()]
            tokens = int(train.sum()) + held.count(False)
            row = ["blocks", block, None, None, None, None, ids, held, _pack(each), _pack(flat), _pack(hashes), _pack(ends), tokens]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)
            for i in range(0, n, 50_000):
                m = min(50_000, n - i)
                cols = [pa.repeat("words", m), pa.repeat(block, m), np.arange(i, i + m, dtype=np.int32), words.slice(i, m), ends[i : i + m].astype(np.int32), tf[i : i + m]]
                yield pa.RecordBatch.from_arrays([*(c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), *(pa.nulls(m, k) for k in kinds[6:])], names=names)

        for b in batches:
            id_type, at = b.schema.field(0).type, 0
            size = np.cumsum(pc.binary_length(b.column(2)).to_numpy().astype(np.int64) + 64)
            while at < b.num_rows:
                # a block ends with the text that brings it to BLOCK_BYTES
                before = int(size[at - 1]) if at else 0
                upto = int(np.searchsorted(size, before + BLOCK_BYTES - load)) + 1
                full, upto = upto <= b.num_rows, min(upto, b.num_rows)
                part = b.slice(at, upto - at)
                words, n = split_words(part.column(2))
                ids += part.column(0).to_pylist()
                held += part.column(1).to_pylist()
                lengths.append(n)
                parts.append(words)
                load += int(size[upto - 1]) - before
                at = upto
                if full:
                    yield from out()
                    ids, held, lengths, parts, load, made = [], [], [], [], 0, made + 1
        if ids:
            yield from out()

    word = "block long, place int, word binary, ending int, tf long"
    block = f"ids array<{id_kind}>, held array<boolean>, lengths binary, numbers binary, hashes binary, endings binary, tokens long"
    path = new_path(spark, "texts")
    # one pass writes both tables; a writer for each, so that rows need not be sorted by kind
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers, None)
    spark.conf.set(writers, "2")
    try:
        rows.mapInArrow(giving_back(run), f"kind string, {word}, {block}").write.partitionBy("kind").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(writers, before) if before is not None else spark.conf.unset(writers)
    for kind in ("blocks", "words"):
        make_dir(spark, f"{path}/kind={kind}")  # no texts, no folders
    return spark.read.schema(f"block long, {block}").parquet(f"{path}/kind=blocks"), spark.read.schema(word).parquet(f"{path}/kind=words")


def start(states: int = STATES, classes: int = CLASSES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, transition and emission (class by state) probabilities to begin with: seeded, and so uneven that the states differ from the first round on."""
    r = np.random.default_rng(seed)
    a = r.dirichlet(np.ones(states), states)
    b = 0.05 + r.gamma(0.3, size=(classes, states))
    return np.full(states, 1 / states), a, b / b.sum(0)


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Texts in groups of about LOAD tokens, longest first, so that those of a group are of like length."""
    order = np.argsort(-lengths, kind="stable")
    cut = np.cumsum(lengths[order] + 1) // LOAD
    for k in np.unique(cut):
        yield order[cut == k]


class Recursion:
    """Scaled forward (and backward) recursions over a group of class sequences at once, longest first; each ends with the end class.

    Steps are taken in spans of about HELD tokens. The forward recursion holds one span; the backward one
    holds one too and makes it again from the state at its start, so that a text of any length has room.
    Within a span it goes by parts of about MOVES rows, and what it makes of a part takes the part's place,
    so that one table of a span's steps and states is held and not one for each of its factors.
    """

    def __init__(self, model: tuple, sequences: list[np.ndarray], load: int | None = None):
        self.pi, self.a, self.b = model
        self.n = np.array([len(s) for s in sequences])
        longest = int(self.n[0])
        # texts going on at each step are the first of the group
        self.live = len(sequences) - np.searchsorted(self.n[::-1], np.arange(longest), side="right")
        self.at = np.concatenate(([0], np.cumsum(self.live)))
        flat = np.concatenate(sequences)
        begin = np.concatenate(([0], np.cumsum(self.n)[:-1]))
        step = np.repeat(np.arange(longest), self.live)
        self.which = np.arange(len(flat)) - np.repeat(self.at[:-1], self.live)
        self.obs = flat[begin[self.which] + step]
        cut = self.at[:-1] // (load or HELD)
        edges = np.flatnonzero(np.concatenate(([True], cut[1:] != cut[:-1])))
        self.spans = list(zip(edges.tolist(), [*edges[1:].tolist(), longest], strict=True))

    def span(self, first: int, last: int, prev: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """alpha and scales of the steps from first to last, after prev, and the last alpha."""
        base = self.at[first]
        alpha = np.take(self.b, self.obs[base : self.at[last]], 0)
        scale, one = np.empty(len(alpha), alpha.dtype), np.ones(len(self.pi), alpha.dtype)
        for t in range(first, last):
            lo, hi = self.at[t] - base, self.at[t + 1] - base
            x = alpha[lo:hi]
            x *= self.pi if prev is None else prev[: hi - lo] @ self.a
            s = x @ one
            x /= s[:, None]
            prev, scale[lo:hi] = x, s
        return alpha, scale, prev

    def forward(self) -> np.ndarray:
        """Natural log likelihoods."""
        total, prev = np.zeros(len(self.n)), None
        for first, last in self.spans:
            _, scale, prev = self.span(first, last, prev)
            total += np.bincount(self.which[self.at[first] : self.at[last]], np.log(scale, dtype=np.float64), len(total))
            prev = prev.copy()
        return total

    def expect(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first states, transitions, and emissions (class by state), and the natural log likelihood of all."""
        k, like, prev, starts, back = len(self.pi), 0.0, None, [], np.ascontiguousarray(self.a.T)
        for first, last in self.spans:
            starts.append(prev)
            made = None
            made = self.span(first, last, prev)
            like += float(np.log(made[1], dtype=np.float64).sum())
            prev = made[2].copy()
        moves, emit, w, one = np.zeros((k, k)), np.zeros((len(self.b), k)), None, np.ones(MOVES, self.b.dtype)
        for i in range(len(self.spans) - 1, -1, -1):
            first, last = self.spans[i]
            alpha, scale = (made if i == len(self.spans) - 1 else self.span(first, last, starts[i]))[:2]
            base, made = self.at[first], None
            obs, at = self.obs[base : self.at[last]], self.at[first : last + 1] - base
            if w is not None:
                moves += alpha[at[-2] : at[-2] + len(w)].T @ w
            # each row after the first step moved there from the row of its text a step before
            step = np.repeat(self.live[first : last - 1], self.live[first + 1 : last])
            cut = at[:-1] // MOVES
            edges = [*np.flatnonzero(np.concatenate(([True], cut[1:] != cut[:-1]))).tolist(), last - first]
            for p, q in zip(edges[-2::-1], edges[:0:-1], strict=True):
                low, high = int(at[p]), int(at[q])
                e = np.take(self.b, obs[low:high], 0)
                e /= scale[low:high, None]
                beta, own = np.empty_like(e), (at[p : q + 1] - low).tolist()
                for lo, hi in zip(own[-2::-1], own[:0:-1], strict=True):
                    now, n = e[lo:hi], 0 if w is None else len(w)
                    if n:
                        now[:n] *= np.matmul(w, back, out=beta[lo : lo + n])
                    beta[lo + n : hi] = 1
                    w = now
                for lo in range(max(low, int(at[1])), high, MOVES):
                    hi = min(lo + MOVES, high)
                    moves += np.take(alpha, np.arange(lo, hi) - step[lo - at[1] : hi - at[1]], 0).T @ e[lo - low : hi - low]
                alpha[low:high] *= beta
            w, e, beta, now = w.copy(), None, None, None
            begun = alpha[: self.live[first]].sum(0, dtype=np.float64)
            order = np.argsort(obs, kind="stable")
            for low in range(0, len(order), MOVES):
                rows = np.take(alpha, order[low : low + MOVES], 0)
                seen = obs[order[low : low + MOVES]]
                edge = np.flatnonzero(np.concatenate(([True], seen[1:] != seen[:-1], [True])))
                for c, lo, hi in zip(seen[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    emit[c] += one[: hi - lo] @ rows[lo:hi] if hi - lo > 1 else rows[lo]
            alpha = None
        return begun, moves * self.a, emit, like


def _sequences(numbers: np.ndarray, classes: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(lengths)
    return [np.append(classes[numbers[ends[i] - lengths[i] : ends[i]]], np.uint16(END)) for i in pick]


def sampled(blocks: DataFrame, share: float, classes: Classes, n_parts: int = PARTS) -> DataFrame:
    """About a share of the training texts, picked and dealt by hashes of ids and words: n_parts rows (held, lengths, numbers, classes)."""
    least = int(share * 2**64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, texts = [], []
            for ids, held, lengths, numbers, hashes, endings in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lengths, flat = _unpack(lengths, np.int32), classes(_unpack(hashes, np.uint64), _unpack(endings, np.uint16))[_unpack(numbers, np.uint32)]
                ends = np.cumsum(lengths)
                for i in np.flatnonzero(~np.array(held, bool)):
                    text = flat[ends[i] - lengths[i] : ends[i]].tobytes()
                    h = xxhash.xxh64_intdigest(str(ids[i]).encode() + text)
                    if h < least:
                        parts.append(h % n_parts)
                        texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(texts, pa.binary())], names=["part", "text"])

    def gather(t: pa.Table) -> pa.Table:
        texts = [np.frombuffer(x, np.uint16) for x in sorted(t.column("text").to_pylist())]
        lengths, flat = np.array([len(x) for x in texts], np.int32), np.concatenate(texts).astype(np.uint32)
        return pa.table({"held": pa.array([[False] * len(texts)], pa.list_(pa.bool_())), "lengths": [_pack(lengths)], "numbers": [_pack(flat)], "classes": [_pack(np.arange(CLASSES, dtype=np.uint16))]})

    rows = blocks.select("ids", "held", "lengths", "numbers", "hashes", "endings").mapInArrow(giving_back(pick), "part int, text binary")
    return rows.groupBy("part").applyInArrow(gather, "held array<boolean>, lengths binary, numbers binary, classes binary")


def train(blocks: DataFrame, classes: Classes, tolerance: float = TOLERANCE, states: int = STATES, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch over the training texts of all blocks, to the tolerance; from a model of a sample where they have over twice its tokens, that of the largest such sample."""
    model = start(states)
    n = blocks.agg(F.sum("tokens")).first()[0] or 0
    while n > 2 * sample:
        some = materialize(sampled(blocks, sample / n, classes, max(PARTS, sample // SAMPLE)), "sample", "gathered")
        model = climb(some, None, model, tolerance)
        drop(some)
        sample *= NEXT
    return climb(blocks.select("held", "lengths", "numbers", "hashes", "endings"), classes, model, tolerance)


def climb(rows: DataFrame, classes: Classes | None, model: tuple, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounds of Baum-Welch from a model until one gains less than the tolerance; the likelihood has a bound, so they end."""
    states, last = len(model[0]), -np.inf
    size = states + states * states + CLASSES * states + 1
    while True:

        def expect(batches: Iterator[pa.RecordBatch], model=tuple(x.astype(np.float32) for x in model)) -> Iterator[pa.RecordBatch]:
            total, any_ = np.zeros(size, np.int64), False
            for b in batches:
                for held, lengths, numbers, *told in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    lengths, numbers = _unpack(lengths, np.int32), _unpack(numbers, np.uint32)
                    cls = classes(_unpack(told[0], np.uint64), _unpack(told[1], np.uint16)) if classes else _unpack(told[0], np.uint16)
                    mine = np.flatnonzero(~np.array(held, bool))
                    for g in _groups(lengths[mine]):
                        first, moves, emit, like = Recursion(model, _sequences(numbers, cls, lengths, mine[g])).expect()
                        total += np.rint(np.concatenate((first, moves.ravel(), emit.ravel(), [like / np.log(10)])) * UNIT).astype(np.int64)
                        any_ = True
            if any_:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"i": at.astype(np.int32), "n": total[at]})

        got = rows.mapInArrow(giving_back(expect), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # a row for each number of the model at most
        if not got.num_rows:
            return model
        sums = np.zeros(size)
        sums[got.column("i").to_numpy()] = got.column("n").to_numpy() / UNIT
        counts = sums[states + states**2 : -1].reshape(CLASSES, states)
        like = sums[-1] / counts.sum()
        first, moves, emit = sums[:states] + 1, sums[states : states + states**2].reshape(states, states) + 1, counts + 0.01
        model = first / first.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0)
        if like - last < tolerance:
            return model
        last = like


def score_blocks(blocks: DataFrame, words: DataFrame, model: tuple, classes: Classes, known_classes: tuple, n_tokens: int, n_ends: int, id_type, state_kind: str) -> DataFrame:
    """_id, held, n_tokens, n_known, base, score: base and score as log10.

    words: block, place, c (times in all training texts). known_classes: by class, training tokens and different words.
    """
    per, kinds = known_classes
    distinct = int(kinds.sum()) + (1 if n_ends else 0)
    floor = np.log10(n_tokens + distinct + 1)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()  # what the block before has left
        place, c = right.column("place").to_numpy(), right.column("c").to_numpy()
        count = np.zeros(len(place), np.int64)
        count[place] = c
        ids, held, at = [], [], []
        for row in left.to_pylist():
            lengths, numbers = _unpack(row["lengths"], np.int32), _unpack(row["numbers"], np.uint32)
            cls = classes(_unpack(row["hashes"], np.uint64), _unpack(row["endings"], np.uint16))
            own = np.log10(count + 1) - floor
            given = np.log10((count + 1) / (per[cls] + kinds[cls] + 1))
            known = (count > 0).astype(np.int64)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            base = np.bincount(doc, own[numbers], len(lengths)) + np.log10(n_ends + 1) - floor
            words_ = np.bincount(doc, given[numbers], len(lengths))
            n_known = np.bincount(doc, known[numbers], len(lengths)).astype(np.int64) + (1 if n_ends else 0)
            states = np.empty(len(lengths))
            for g in _groups(lengths):
                states[g] = Recursion(model, _sequences(numbers, cls, lengths, g)).forward() / np.log(10)
            ids += row["ids"]
            held += row["held"]
            at.append((lengths.astype(np.int64) + 1, n_known, base, words_ + states))
        cols = [np.concatenate(x) for x in zip(*at, strict=True)] if at else [np.empty(0)] * 4
        return pa.table({"_id": pa.array(ids, id_type), "held": pa.array(held, pa.bool_()), "n_tokens": cols[0], "n_known": cols[1], "base": cols[2], "score": cols[3]})

    b = blocks.select("block", "ids", "held", "lengths", "numbers", "hashes", "endings")
    schema = f"_id {state_kind}, held boolean, n_tokens long, n_known long, base double, score double"
    return b.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, schema)


def count_words(words: DataFrame) -> tuple[DataFrame, Classes, tuple[np.ndarray, np.ndarray]]:
    """Counts of all words (word, c: times in all training texts, n: blocks), the classes, and by class the training tokens and different words."""
    counts = words.groupBy("word").agg(F.sum("tf").alias("c"), F.count(F.lit(1)).alias("n"), F.first("ending").alias("ending"))
    counts = materialize(counts, "counts", "fewer")
    known = counts.where("c > 0")
    common = known.orderBy(F.col("c").desc(), "word").limit(FREQUENT).select("word", "c", "ending").collect()
    per, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in known.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # at most ENDINGS rows
        per[1 + FREQUENT + r["ending"]], kinds[1 + FREQUENT + r["ending"]] = r["c"], r["v"]
    for i, r in enumerate(common, 1):
        per[1 + FREQUENT + r["ending"]] -= r["c"]
        kinds[1 + FREQUENT + r["ending"]] -= 1
        per[i], kinds[i] = r["c"], 1
    return counts.drop("ending"), Classes([bytes(r["word"]) for r in common]), (per, kinds)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "_held", tolerance: float = TOLERANCE) -> DataFrame:
    """Train on the rows of docs that are not held out and score all: _id, held, n_tokens, n_known, train_tokens, base, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    blocks, words = read_blocks(docs, id_col, text_col, held_col)
    counts, classes, (per, kinds) = count_words(words)
    model = train(blocks, classes, tolerance)
    n_ends = blocks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    n = int(per.sum()) + n_ends
    own = join_counted(words.select("block", "place", "word"), counts, "word").select("block", "place", "c")
    out = score_blocks(blocks, own, model, classes, (per, kinds), n, n_ends, to_arrow_type(kind), kind.simpleString())
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    s = score_texts(fold(docs.select("doc_id", "text"), "doc_id", 7))
    return s.select(F.col("_id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", F.col("base").alias("base_score"), "score")
