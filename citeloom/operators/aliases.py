"""Identities that decisions share: alias tables, their closure, and chapters borrowed from citations of one title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_column


def apply_aliases(citations: DataFrame, aliases: DataFrame, use: bool = True) -> DataFrame:
    """citations (key, core, court) with alias_key: the identity of an alias by key, else by observed spelling.

    aliases: written (a key or a spelling), key, court (null: any). A spelling counts only for the court it
    was seen with. Where use is false, keys stay as written.
    """
    if not use:
        return citations.withColumn("alias_key", F.col("key"))
    by_key = aliases.select(F.col("written").alias("_w1"), F.col("key").alias("_k1"))
    by_text = aliases.select(fold_column(F.col("written")).alias("_w2"), F.col("key").alias("_k2"), F.col("court").alias("_c2"))
    j = citations.join(by_key, F.col("key") == F.col("_w1"), "left")
    j = j.join(by_text, (fold_column(F.col("core")) == F.col("_w2")) & (F.col("_c2").isNull() | F.col("court").isNull() | (F.col("court") == F.col("_c2"))), "left")
    return j.withColumn("alias_key", F.coalesce("_k1", "_k2", "key")).drop("_w1", "_k1", "_w2", "_k2", "_c2")


def closed_groups(groups: DataFrame) -> DataFrame:
    """groups (index, keys) → index, link (least index with the same set), conflict (another set shares a key)."""
    g = groups.select("index", F.array_sort(F.array_distinct("keys")).alias("s"))
    same = g.groupBy("s").agg(F.min("index").alias("link"))
    shared = g.select("s", F.explode("s").alias("k")).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    bad = g.select("s", F.explode("s").alias("k")).join(shared, "k", "left_semi").select("s").distinct().withColumn("conflict", F.lit(True))
    return g.join(same, "s").join(bad, "s", "left").select("index", "link", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def titled_chapters(rows: DataFrame) -> DataFrame:
    """rows (doc_id, title, series, year, chapter) with borrowed: a missing chapter is that of the document's other citations of the title, if they agree."""
    known = rows.where("chapter is not null").groupBy("doc_id", "title", "series", "year").agg(F.min("chapter").alias("_lo"), F.max("chapter").alias("_hi"))
    j = rows.join(known, ["doc_id", "title", "series", "year"], "left")
    return j.withColumn("borrowed", F.coalesce("chapter", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")))).drop("_lo", "_hi")


def chapter_twins(rows: DataFrame) -> DataFrame:
    """rows (doc_id, series, year, chapter) with read: of chapters that scans confuse (O and 0, l and 1) the spelling most used in the document, none changed on a tie."""
    plain = F.translate(F.upper("chapter"), "OIL", "011")
    votes = rows.groupBy("doc_id", "series", "year", plain.alias("_p"), "chapter").agg(F.count(F.lit(1)).alias("n"))
    ranked = votes.groupBy("doc_id", "series", "year", "_p").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "chapter"))).alias("v"))
    clear = (F.size("v") == 1) | (F.get("v", F.lit(0))["n"] < F.get("v", F.lit(1))["n"])
    best = ranked.select("doc_id", "series", "year", "_p", F.when(clear, F.get("v", F.lit(0))["chapter"]).alias("_b"))
    return rows.withColumn("_p", plain).join(best, ["doc_id", "series", "year", "_p"], "left").withColumn("read", F.coalesce("_b", "chapter")).drop("_p", "_b")
