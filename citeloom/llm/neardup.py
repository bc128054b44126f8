"""Near-duplicates by Order MinHash with verification by banded alignment.

A text is its sequence of five-word shingles (a shorter text is one shingle). Each of ``SKETCHES`` hash
functions samples the ``ORDER`` least shingles, labelled by their occurrence, and keeps them in text order,
so that equal sketches speak for a like order and not only for like sets. Texts that share a sketch are
candidates. A text that repeats shingles has sketches of its different shingles too, since these are what is
verified; one of few also has the hash of its whole set and of each set with one shingle less as keys (with
two less where it has ``TINY`` + 2), so that texts of up to ``TINY`` find every partner of similarity 0.8.

Candidates are verified on the sequences of different shingles: a banded alignment (longest common
subsequence within the band that the threshold allows) of L shingles has similarity L / (a + b - L), the
Jaccard similarity of the shingles that keep their order; it has to be 0.8 or more.

Equal texts are one node. In a bucket of up to ``SMALL`` nodes all are compared. In a larger one all are
compared with the node that shares most (its hub). Where some are then not connected with their hub, the
nodes of such buckets are dealt to new buckets by the rarest of their shingles, of which two texts of
similarity 0.8 have one in common: an exact way, in which texts that share common passages only do not meet.
Large buckets of these are treated in the same way, and what is still apart in them (texts whose rarest
shingles are common and that are unlike the hub) is compared with all of its bucket, in blocks.

Null texts and texts without a word are in no group: a class of their own. Null ids form no class id where
another id is there. Repeated rows fall into one class. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .quality import mix
from .scratch import bound_batches, drop, join_counted, materialize, sized

SHINGLE, SIMILAR = 5, 0.8
SKETCHES, ORDER, TINY = 24, 4, 8
SMALL = 16
#: Nodes in a block of the left and of the right side of a comparison.
LEFT, RIGHT = 256, 1024
#: Words and texts whose hashes and keys a worker remembers.
REMEMBERED, KEPT = 100_000, 5_000
#: Hashes of a text's shingles that are held at once.
HELD = 1 << 16
FACTORS = mix(np.arange(1, SHINGLE + 1)) | np.uint64(1)
SEEDS = mix(np.arange(101, 101 + SKETCHES)) | np.uint64(1)
PLACES = mix(np.arange(301, 301 + ORDER)) | np.uint64(1)


class Hashes(dict):
    """Words to their hashes, as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Texts to hashes of shingles, with a memory for words."""

    def __init__(self) -> None:
        self.known = Hashes()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        v = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        long = min(len(v), SHINGLE)
        n, places = len(v) - long + 1, np.arange(long, dtype=np.uint64)[:, None]
        h = np.empty(n, np.uint64)
        for i in range(0, n, HELD):  # a long text in parts
            part = np.lib.stride_tricks.sliding_window_view(v[i : i + HELD + long - 1], long).T
            h[i : i + HELD] = mix(part * FACTORS[:long, None] + places).sum(axis=0, dtype=np.uint64) + np.uint64(long)
        return mix(h)


def label(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with their occurrence mixed in, and the places of first occurrences."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    edge = np.concatenate(([True], s[1:] != s[:-1]))
    if edge.all():
        return h, np.arange(len(h))
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(edge, np.arange(len(h)), 0))
    nth = np.empty(len(h), np.uint64)
    nth[order] = run
    return np.where(nth > 0, mix(h + nth * np.uint64(0x9E3779B97F4A7C15)), h), np.sort(order[edge])


def samples(seq: np.ndarray) -> np.ndarray:
    """SKETCHES keys of a sequence of different values: each of the ORDER that a hash function puts first, in the order of the text."""
    k, places = min(ORDER, len(seq)), []
    some = max(1, HELD // len(seq))  # hash functions that are taken at once
    for i in range(0, SKETCHES, some):
        x = seq * SEEDS[i : i + some, None]
        x ^= x >> np.uint64(31)
        x *= SEEDS[::-1][i : i + some, None]
        places.append(np.argpartition(x, k - 1, axis=1)[:, :k] if k < len(seq) else np.tile(np.arange(k), (len(x), 1)))
    at = np.sort(np.concatenate(places), axis=1)
    keys = (seq[at] * PLACES[:k]).sum(axis=1, dtype=np.uint64)
    return mix(keys * SEEDS + np.arange(SKETCHES, dtype=np.uint64))


def sketch(h: np.ndarray) -> list[int]:
    """The keys of a text, as signed 64-bit values: samples of its labelled shingles and, where some repeat, of the different ones too."""
    labelled, first = label(h)
    keys = [samples(labelled)]
    if len(first) < len(h):
        keys.append(samples(h[first]))
    if len(first) <= TINY + 2:
        # a partner of similarity 0.8 lacks one shingle of up to TINY + 1, or two of TINY + 2
        parts = mix(h[first])
        whole, n = parts.sum(dtype=np.uint64), len(parts)
        keys.append(mix(np.array([whole])))
        if 1 < n <= TINY + 1:
            keys.append(mix(whole - parts))
        if n == TINY + 2:
            i, j = np.triu_indices(n, 1)
            keys += [mix(whole - parts), mix(whole - parts[i] - parts[j])]
    return np.unique(np.concatenate(keys)).view(np.int64).tolist()


def common(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence of a and b, places at most band apart; each has different elements.

    One bit for each place of the band: bit i of the window at step j stands for place j - band + i of a.
    """
    place = {x: i for i, x in enumerate(a)}
    width = 2 * band + 1
    full, v, lost = (1 << width) - 1, (1 << width) - 1, 0
    for j, x in enumerate(b):
        if j:  # the window moves on by one place
            lost += not v & 1
            v = v >> 1 | 1 << (width - 1)
        i = place.get(x)
        if i is not None and 0 <= (at := i - j + band) < width:
            bit = 1 << at
            u = v & bit
            v = ((v + u) | (v & ~bit)) & full
    return lost + width - v.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether sequences of different shingles have a banded alignment of at least the similarity."""
    need = int(np.ceil(round((len(a) + len(b)) * least / (1 + least), 9)))
    if min(len(a), len(b)) < need:
        return False
    a, b, same, most = a.tolist(), b.tolist(), 0, min(len(a), len(b))
    while same < most and a[same] == b[same]:
        same += 1
    tail = 0
    while tail < most - same and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    band = len(a) + len(b) - 2 * need  # more shingles without partner than this are too many
    return same + tail + common(a[same : len(a) - tail], b[same : len(b) - tail], band) >= need


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, node (md5 of the text, 16 bytes), keys; node is null where the text has no word."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.unhex(F.md5(f"`{text_col}`")).alias("node"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(), {}

        def keys_of(node: bytes | None, text: bytes) -> list[int] | None:
            if node not in known:
                if len(known) >= KEPT:
                    known.clear()
                h = shingler(text)
                known[node] = sketch(h) if len(h) else None
            return known[node]

        for b in batches:
            keys = [keys_of(n, t) for n, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            node = [n if k else None for n, k in zip(b.column(1).to_pylist(), keys, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "node", "keys"])

    return rows.mapInArrow(run, f"_id {kind}, node binary, keys array<long>")


class Postings:
    """Sequences of different values, asked which of them may be similar to another one."""

    def __init__(self, sequences: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sequences], np.int64)
        flat = np.concatenate([*sequences, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sequences)), self.sizes)[order]
        self.values, first, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.first = first.astype(np.int64)

    def similar(self, h: np.ndarray) -> np.ndarray:
        """Places of those whose similarity without regard to order, never less than that with it, is enough."""
        if not len(self.values):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, h), len(self.values) - 1)
        at = at[self.values[at] == h]
        counts = self.counts[at]
        places = np.repeat(self.first[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        shared = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero((shared > 0) & (shared >= SIMILAR * (len(h) + self.sizes - shared) - 1e-9))


def compare(tasks: DataFrame, texts: DataFrame) -> DataFrame:
    """tasks (task, side, node, group) → links (a, b): verified pairs of a task's left (0) and right (1) nodes.

    Nodes of one group need no link. Of the links of a task those that close a circle are left out.
    """
    rows = tasks.join(texts, "node").select("task", "side", "node", "group", "text")
    n = max(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(n, "task").sortWithinPartitions("task", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, task, left, index, root, found = Shingler(), None, [], None, {}, []

        def top(x: bytes) -> bytes:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for b in batches:
            for t, side, node, group, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t != task:
                    task, left, index, root = t, [], None, {}
                h = shingler(text)
                h = h[label(h)[1]]
                if group is not None and top(group) != top(node):
                    root[top(node)] = top(group)
                if side == 0:
                    left.append((node, h))
                    continue
                # the left side comes first
                index = index or Postings([g for _, g in left])
                for i in index.similar(h).tolist():
                    other, g = left[i]
                    if top(node) != top(other) and aligned(g, h):
                        root[top(node)] = top(other)
                        found.append((other, node))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])
                found = []

    return rows.mapInArrow(run, "a binary, b binary")


def star(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of buckets (key, node, size, group, apart): the pairs to compare first (a, b, size), the members of large buckets, and their hubs (key, hub).

    Small buckets give all pairs; of a large one each node is paired with its hub, the node whose large
    buckets hold most. Pairs of one group and those of which neither node is apart are left out.
    """
    if "group" not in members.columns:
        members = members.withColumn("group", F.lit(None).cast("binary")).withColumn("apart", F.lit(True))
    side = lambda i: [F.col(c).alias(f"{c}{i}") for c in ("node", "group", "apart")]
    wanted = (F.col("apart1") | F.col("apart2")) & ~F.coalesce(F.col("group1") == F.col("group2"), F.lit(False))
    ends = [F.col("node1").alias("a"), F.col("node2").alias("b"), "size"]
    small, large = members.where(F.col("size") <= SMALL), members.where(F.col("size") > SMALL)
    pairs = small.select("key", "size", *side(1)).join(small.select("key", *side(2)), "key").where("node1 < node2").where(wanted).select(*ends)
    weight = large.groupBy("node").agg(F.sum("size").alias("weight"))
    best = large.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "group", "apart")).alias("h"), F.first("size").alias("n"))
    hubs = materialize(best.select("key", *[F.col(f"h.{c}").alias(f"{c}1") for c in ("node", "group", "apart")], "n"), "hubs", "fewer")
    spokes = join_counted(large.select("key", "size", *side(2)), hubs, "key").where("node1 <> node2").where(wanted).select(*ends)
    both = materialize(pairs.unionByName(spokes).groupBy("a", "b").agg(F.max("size").alias("size")), "pairs", "gathered")
    out = hubs.select("key", F.col("node1").alias("hub"), "n")
    out._citeloom_path = hubs._citeloom_path
    return both, large.select("key", "node", "size"), out


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among pairs (a, b, size). The right sides of one left side that come from a large bucket are dealt to many tasks."""
    dealt = pairs.withColumn("task", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / RIGHT).cast("int"))))
    none = F.lit(None).cast("binary").alias("group")
    left = dealt.select("task", F.lit(0).alias("side"), F.col("a").alias("node"), none).distinct()
    tasks = left.unionByName(dealt.select("task", F.lit(1).alias("side"), F.col("b").alias("node"), none).distinct())
    return materialize(compare(tasks, texts), "links", "gathered")


def left_apart(large: DataFrame, hubs: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (key, node, group, apart) of the large buckets in which some node is not in its hub's group (apart)."""
    group = groups.select("node", F.col("label").alias("group"))
    of_hub = hubs.join(group.select(F.col("node").alias("hub"), F.col("group").alias("hub_group")), "hub", "left")
    rest = join_counted(large.drop("size").join(group, "node", "left"), materialize(of_hub, "hubs", "fewer"), "key")
    apart = ~F.coalesce(F.col("group") == F.col("hub_group"), F.col("node") == F.col("hub"))
    rest = rest.withColumn("apart", apart).select("key", "node", "group", "apart")
    some = rest.where("apart").groupBy("key").agg(F.count(F.lit(1)).alias("u"))
    return materialize(rest.join(some.select("key"), "key"), "apart", "fewer")


def prefixes(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Buckets (key, node, size, group, apart) of nodes (node, group, apart) by the rarest of their shingles: the exact way for large buckets.

    Shingles are ordered by how many of the nodes have them. Of n different shingles a partner of similarity
    0.8 lacks a fifth at most, so that the first n - ceil(0.8 n) + 1 of either have one in common. Those that
    one node alone has come first and are only counted. Buckets without a node that is apart are left out.
    """
    rows = nodes.join(texts, "node").select(F.xxhash64("node").alias("_n"), "apart", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for node, apart, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = np.unique(shingler(text)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node)), pa.array(np.full(len(h), len(h), np.int32)), pa.array([apart] * len(h), pa.bool_()), pa.array(h)], names=["_n", "of", "apart", "key"])

    each = materialize(rows.mapInArrow(run, "_n long, of int, apart boolean, key long"), "shingles")
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("any")).where("n > 1")
    counts = materialize(counts.withColumn("df", F.col("n")), "counts", "fewer")
    shared = join_counted(each.select("_n", "of", "key"), counts, "key")
    ranked = shared.groupBy("_n").agg(F.first("of").alias("of"), F.array_sort(F.collect_list(F.struct("df", "key", "any"))).alias("s"))
    first = F.expr(f"slice(s, 1, greatest(0, cast(of - ceil(round({SIMILAR} * of, 6)) + 1 - (of - size(s)) as int)))")
    rare = ranked.select("_n", F.explode(first).alias("x")).where("x.any").select(F.col("x.key").alias("key"), "_n")
    rare = materialize(rare, "rare")
    sizes = materialize(rare.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n")), "sizes", "fewer")
    names = nodes.select(F.xxhash64("node").alias("_n"), "node", "group", "apart")
    out = join_counted(rare, sizes, "key").join(names, "_n").select("key", "node", "size", "group", "apart")
    out = materialize(out, "members", "gathered")
    for x in (each, counts, rare, sizes):
        drop(x)
    return out


def all_pairs(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of each node that is apart with all nodes of its bucket (rest: key, node, group, apart), in blocks of bounded size."""
    sizes = rest.groupBy("key").agg(F.sum(F.col("apart").cast("int")).alias("u"), F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("key", F.ceil(F.col("u") / LEFT).cast("int").alias("lefts"), F.ceil(F.col("n") / RIGHT).cast("int").alias("rights"), "n")
    rest = join_counted(rest, materialize(sizes, "sizes", "fewer"), "key")
    block = F.xxhash64("node")
    left = rest.where("apart").withColumn("l", F.pmod(block, F.col("lefts"))).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rights") - 1)))
    right = rest.withColumn("r", F.pmod(block, F.col("rights"))).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)))
    deal = lambda x, side: x.select(F.xxhash64("key", F.col("l").cast("long"), F.col("r").cast("long")).alias("task"), F.lit(side).alias("side"), "node", "group")
    return materialize(compare(deal(left, 0).unionByName(deal(right, 1)), texts), "links", "gathered")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: _id, node, label (a node of its class; null without words), class_id (the least id of its class)."""
    made = materialize(sketches(docs, id_col, text_col), "sketches")
    nodes = made.where("node is not null").groupBy("node").agg(F.min("_id").alias("rep"))
    each = made.where("node is not null").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    sizes = materialize(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n")), "sizes", "fewer")
    members = materialize(join_counted(each, sizes, "key"), "members", "gathered")
    candidates = members.select("node").distinct()
    # the text of a candidate comes from its representative alone, not from each copy
    wanted = nodes.join(candidates, "node").select(F.col("node").alias("n2"), "rep")
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.unhex(F.md5(f"`{text_col}`")).alias("node"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    texts = source.join(wanted, (F.col("node") == F.col("n2")) & F.col("_id").eqNullSafe(F.col("rep"))).select("node", "text")
    texts = materialize(sized(texts.dropDuplicates(["node"]), docs), "texts")
    pairs, large, hubs = star(members)
    links = verify(pairs, texts)
    groups, used = components(links), [sizes, members, texts, pairs, hubs, links]
    # large buckets whose nodes are not all linked with the hub are cut by their rarest shingles, and what is then left by blocks
    if large.limit(1).count():
        rest = left_apart(large, hubs, groups)
        used.append(rest)
        if rest.limit(1).count():
            members = prefixes(rest.groupBy("node").agg(F.first("group").alias("group"), F.max("apart").alias("apart")), texts)
            pairs, large, hubs = star(members)
            more = verify(pairs, texts)
            links = links.unionByName(more)
            groups = components(links)
            rest = left_apart(large, hubs, groups)
            used += [members, pairs, hubs, more, rest]
            if rest.limit(1).count():
                groups = components(links.unionByName(all_pairs(rest, texts)))
    for x in used:
        drop(x)
    of = nodes.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of.groupBy("label").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("n"))
    of = join_counted(of, materialize(least, "least", "fewer"), "label").select(F.col("node").alias("n3"), "label", "class_id")
    # all copies of a text have one node: the rows of the commonest texts stay where they are
    copies = made.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    of = materialize(of.join(copies, F.col("n3") == F.col("node")).select("node", "label", "class_id", "n"), "of", "fewer")
    out = join_counted(made.select("_id", "node"), of, "node", how="left")
    return out.select("_id", "node", "label", F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id."""
    return classes(docs).select(F.col("_id").alias("doc_id"), "class_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of one document of each class: that with the least id.

    Rows that repeat that id and belong to the class too are copies: one of them stays.
    """
    c = materialize(classes(docs, id_col, text_col).where("node is not null"), "classes", "fewer")
    least = c.where(F.col("_id").eqNullSafe(F.col("class_id"))).groupBy("label", "class_id").agg(F.min(F.struct("node")).alias("m"), F.count(F.lit(1)).alias("n"))
    least = materialize(least.select(F.col("class_id").alias("__id"), F.col("m.node").alias("__node"), "n"), "stay", "fewer")
    stay, again = least.drop("n"), least.where("n > 1").limit(1).count()
    node = F.unhex(F.md5(f"`{text_col}`"))
    lone = docs.where(~F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    rest = docs.where(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    kept = rest.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (node == F.col("__node")))
    if again:  # repeated rows
        kept = kept.dropDuplicates(["__id", "__node"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(lone)
