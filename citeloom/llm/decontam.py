"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item is cut into windows of 13 words (a shorter item is one window). A document can hold a window only
if it holds the window's rarest word, so that word, ordered by how often the whole corpus has it, is the
window's necessary prefix: documents' words are joined with these prefixes only. The place of the prefix
in the window gives the one place where the window could start (positional bound), which has to leave room
for the whole window (length bound); then the words there are compared one by one with the window's.

Null and empty texts have no words. Null item ids mark hits but are not listed. Repeated rows of either
table change nothing in each other's results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import join_counted, materialize

#: Fixed values of the contract.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
#: Windows broadcast at once, about 40 MB. More of them are joined in blocks of this size.
BLOCK = 100_000
#: Bytes of keys of contaminated documents, ROW_BYTES for each row beside its key, that are broadcast.
BROADCAST, ROW_BYTES = 32 << 20, 64


def words(text: Column) -> Column:
    """Lower-cased (A to Z only) runs of ASCII letters, digits and characters beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """win (array of words), items (ids of the items that have it): each different window once."""
    w = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words(F.col(f"`{text_col}`")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    return w.groupBy("win").agg(F.collect_set("item").alias("items"))


def _blocks(table: DataFrame, by: str, block: int) -> list[DataFrame]:
    n = table.count()
    k = max(1, -(-n // block))
    return [table] if k == 1 else [table.where(F.pmod(F.xxhash64(by), F.lit(k)) == i) for i in range(k)]


def word_counts(tokens: DataFrame, vocabulary: DataFrame, block: int = 5 * BLOCK) -> DataFrame:
    """vocabulary (word and more) with freq: how often all documents (tokens: _w) have each word."""
    out = None
    for part in _blocks(vocabulary, "word", block):
        c = tokens.select(F.explode("_w").alias("word")).join(F.broadcast(part.select("word")), "word").groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
        out = c if out is None else out.unionByName(c)
    return vocabulary.join(out, "word", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))


def with_prefix(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows with prefix (its rarest word; of equals the first by code point), offset (its first place, from 0) and len.

    counts: word, freq and n, the number of windows that have the word.
    """
    each = join_counted(windows.select("win", F.explode(F.array_distinct("win")).alias("word")), counts, "word")
    rare = each.groupBy("win").agg(F.min(F.struct("freq", "word")).alias("r"))
    return windows.join(rare, "win").select(F.col("r.word").alias("prefix"), (F.array_position("win", F.col("r.word")) - 1).cast("int").alias("offset"), F.size("win").alias("len"), "win", "items")


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """A row for each row of docs and one for each occurrence of a window in it: _id, _h, n, start (from 1; null in the former), len, set; and the sets of items: set, items.

    A hit names its window's set of items, so that a window that many items share costs no more than another.
    """
    windows = materialize(item_windows(benchmark, item_col, item_text_col, window), "windows", "fewer").withColumn("set", F.unhex(F.md5(F.to_json("items"))))
    sets = windows.select("set", "items").dropDuplicates(["set"])
    windows = windows.drop("items").withColumnRenamed("set", "items")
    text = F.col(f"`{text_col}`")
    tokens = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"), words(text).alias("_w"))
    vocabulary = materialize(windows.select(F.explode(F.array_distinct("win")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "vocabulary", "fewer")
    counts = materialize(word_counts(tokens, vocabulary), "counts", "fewer")
    ready = materialize(with_prefix(windows, counts), "prefixes", "gathered").withColumnRenamed("items", "set")
    each = tokens.select("_id", "_h", "_w", F.size("_w").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "_w")).alias("pos", "word"))
    out = None
    for i, part in enumerate(_blocks(ready, "win", block)):
        if i == 0:  # the empty word, first in each document, gives the row that every document has
            one = part.sparkSession.range(1).select(F.lit("").alias("prefix"), F.lit(0).alias("offset"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("win"), F.lit(None).cast("binary").alias("set"))
            part = part.unionByName(one)
        start = F.col("pos") - F.col("offset")
        fits = (start >= 1) & (start + F.col("len") - 1 <= F.col("n"))
        same = F.slice("_w", F.greatest(start, F.lit(1)), F.col("len")) == F.col("win")
        found = each.join(F.broadcast(part), (F.col("word") == F.col("prefix")) & ((F.col("len") == 0) | (fits & same)))
        found = found.select("_id", "_h", "n", F.when(F.col("len") > 0, start).alias("start"), "len", "set")
        out = found if out is None else out.unionByName(found)
    return out, sets


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """A row for each row of docs: _id, _h, n_words, n_hit, items (sorted ids), contaminated."""
    o, sets = occurrences(docs, benchmark, **how)
    hit = F.when(F.col("start").isNotNull(), F.struct("start", "len"))
    g = o.groupBy("_id", "_h").agg(F.max("n").alias("n"), F.sum(F.col("start").isNull().cast("int")).alias("rows"), F.collect_set(hit).alias("hits"), F.collect_set("set").alias("sets"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))
    g = g.select("_id", "_h", F.col("n").cast("long").alias("n_words"), F.size(covered).cast("long").alias("n_hit"), "rows", "sets")
    g = materialize(g, "hits", "fewer")
    told = g.select(F.explode("sets").alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("n")).join(sets, "set")
    each = g.select("_id", "_h", "n_words", "n_hit", "rows", F.explode_outer("sets").alias("set"))
    each = join_counted(each, materialize(told, "sets", "fewer"), "set", how="left")
    g = each.groupBy("_id", "_h", "n_words", "n_hit", "rows").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    g = g.select("_id", "_h", "n_words", "n_hit", "items", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_i")).drop("_i")
    return g.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    c = contamination(docs, benchmark)
    return c.select(F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated.

    The contaminated ones are few beside docs: their ids and hashes are counted and, up to so many bytes,
    sent to all tasks, so that no text is shuffled. Beyond that texts are dealt by key, hot keys apart.
    """
    key = lambda i, h: F.concat_ws("|", F.when(i.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), i.cast("string"))), h.cast("string"))
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col).where("contaminated")
    bad = bad.groupBy(key(F.col("_id"), F.col("_h")).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    bad = materialize(bad.withColumn("__bad", F.lit(True)), "bad", "fewer")
    size = bad.agg(F.coalesce(F.sum(F.octet_length("__key") + ROW_BYTES), F.lit(0))).first()[0]
    kept = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(docs.columns)], key(F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("__key"))
    if size <= broadcast:
        kept = kept.join(F.broadcast(bad.select("__key")), "__key", "left_anti")
    else:
        kept = join_counted(kept, bad, "__key", how="left").where("__bad is null")
    return kept.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])
