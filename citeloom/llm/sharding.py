"""Sharding by a Hilbert curve over quantised metadata, in DataFrame operations only.

Rows are ordered by the curve index of (source, language, log size), and the order is cut into runs: of
equal counts (law ``rows``) or of near equal bytes (law ``bytes``). A run spans a compact region of the
grid, so that its file's minima and maxima prune on each dimension.

Null texts have no bytes; null sources and languages come last in their dimension. Rows with equal id, size
and text are numbered one after the other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import join_counted, materialize, running

BITS, DIMS = 4, 3
#: Rows in a part of a cell of the grid: a cell with a third of all rows is still dealt to many tasks.
PART = 1 << 11


def hilbert_index(point: list[int], bits: int) -> int:
    """Distance along the Hilbert curve of a point with coordinates of so many bits."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess reflections and exchanges, from the top bit on
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    q = 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            flip ^= q - 1
        q >>= 1
    x = [v ^ flip for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | v >> b & 1
    return out


def curve(spark: SparkSession, bits: int = BITS) -> DataFrame:
    """cell, h: the curve index of each of the 2 ** (3 * bits) cells of the grid."""
    side = 1 << bits
    rows = [((a * side + b) * side + c, hilbert_index([a, b, c], bits)) for a in range(side) for b in range(side) for c in range(side)]
    return spark.createDataFrame(rows, "cell int, h int")


def _key(col: str) -> Column:
    """A value of a column, or null, as text."""
    return F.when(F.col(f"`{col}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(f"`{col}`").cast("string")))


def _by_depth(rows: DataFrame, col: str, side: int, total: int) -> DataFrame:
    """_key, q_col, n: each value of a column, its coordinate, so that each coordinate has about as many rows, and its rows."""
    counts = rows.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = running(counts, "n", F.col("v").asc_nulls_last(), name="before")
    q = F.least(F.lit(side - 1), F.floor((F.col("before") + F.col("n") / 2) * side / F.lit(max(total, 1)))).cast("int")
    return placed.select(_key("v").alias(f"_key_{col}"), q.alias(f"q_{col}"), "n")


class Plan:
    """Where rows of a table (_id, size, crc, lang, source) go: made from all of them, and then applied to them or to rows that carry more.

    Exact ranks without one global sort: sums over cells of the grid, over the parts of each cell (of about
    PART rows, by a hash of the row), and then a row number in a part.
    """

    def __init__(self, meta: DataFrame, shards: int, law: str = "rows", bits: int = BITS):
        if law not in ("rows", "bytes"):
            raise ValueError(f"law is rows or bytes, not {law!r}")
        self.shards, self.law, self.bits = shards, law, bits
        self.n, self.b = meta.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.depths = {c: materialize(_by_depth(meta, c, 1 << bits, self.n), "depth", "fewer") for c in ("source", "lang")}
        on_curve = materialize(self._on_curve(meta).select("h", "_id", "crc", "size"), "cells")
        sums = on_curve.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        self.cells = materialize(sums.select("h", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "parts", "fewer")
        parts = self._in_parts(on_curve).groupBy("h", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
        parts = materialize(parts, "sums", "fewer")
        cells = parts.groupBy("h").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        up = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each cell of the grid
        cells = cells.select("h", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("cn"), F.coalesce(F.sum("b").over(up), F.lit(0)).alias("cb"))
        within = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a cell
        before = parts.select("h", "part", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("pn"), F.coalesce(F.sum("b").over(within), F.lit(0)).alias("pb"))
        before = before.join(F.broadcast(cells), "h").select("h", "part", (F.col("pn") + F.col("cn")).alias("n0"), (F.col("pb") + F.col("cb")).alias("b0"))
        self.before = materialize(before, "offsets", "fewer")

    def _on_curve(self, rows: DataFrame) -> DataFrame:
        side = 1 << self.bits
        log_size = F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor(F.log2(F.col("size").cast("double"))) - 4)).cast("int")
        for c, depth in self.depths.items():
            rows = join_counted(rows.withColumn(f"_key_{c}", _key(c)), depth, f"_key_{c}").drop(f"_key_{c}")
        rows = rows.withColumn("cell", (F.col("q_source") * side + F.col("q_lang")) * side + log_size)
        return rows.join(F.broadcast(curve(rows.sparkSession, self.bits)), "cell").drop("cell", "q_source", "q_lang")  # 4096 rows, whatever the data

    def _in_parts(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.cells), "h").withColumn("part", F.pmod(F.xxhash64("_id", "crc", "size"), F.col("parts")).cast("int")).drop("parts")

    def ranked(self, rows: DataFrame) -> DataFrame:
        """rows with h, shard and slot, dealt out by ranges of the curve."""
        shards, order = self.shards, Window.partitionBy("h", "part").orderBy("_id", "crc", "size")
        q = self._in_parts(self._on_curve(rows)).join(self.before, ["h", "part"])
        q = q.repartitionByRange("h", "part").withColumn("rank", F.col("n0") + F.row_number().over(order) - 1)
        if self.law == "rows":
            q = q.withColumn("shard", F.expr(f"cast(cast(rank as decimal(38,0)) * {shards} div {max(self.n, 1)} as int)"))
            first = F.expr(f"(cast(shard as decimal(38,0)) * {self.n} + {shards - 1}) div {shards}").cast("long")
            return q.withColumn("slot", (F.col("rank") - first).cast("long")).drop("n0", "b0", "rank", "part")
        # doubled, so that a row's middle is a whole number
        middle = 2 * (F.col("b0") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
        q = q.withColumn("_middle", middle.cast("decimal(38,0)"))
        q = q.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast(_middle * {shards} div {2 * max(self.b, 1)} as int)")))
        q = materialize(q.drop("_middle"), "cut")
        first = q.groupBy(F.col("shard").alias("s2")).agg(F.min("rank").alias("r0"))  # a row for each shard
        return q.join(F.broadcast(first), F.col("shard") == F.col("s2")).withColumn("slot", (F.col("rank") - F.col("r0")).cast("long")).drop("n0", "b0", "rank", "part", "s2", "r0")


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = False) -> DataFrame:
    """_id, size, crc, lang, source; with carry also _row, all columns of docs."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    return docs.select(F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("crc"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), *rows)


def write_shards(docs: DataFrame, path: str, shards: int, law: str = "rows", **columns: str) -> tuple[str, str]:
    """Write docs, every row and all columns, as Parquet: a folder for each shard, its files in order of the curve.

    Adds the columns shard (the folder) and slot (a row's place in its shard), with underscores before their
    names as long as docs has them; returns the two names. columns: names of those that metadata() reads.
    """
    plan = Plan(materialize(metadata(docs, **columns), "meta"), shards, law)
    rows = plan.ranked(metadata(docs, **columns, carry=True))
    names = []
    for name in ("shard", "slot"):
        while name.lower() in map(str.lower, docs.columns):
            name = f"_{name}"
        names.append(name)
    out = rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns], F.col("slot").alias(names[1]), F.col("shard").alias(names[0]))
    out.sortWithinPartitions(*names).write.partitionBy(names[0]).parquet(path)
    return names[0], names[1]


def digest(docs: DataFrame, shards: int = 8, law: str = "rows") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert."""
    meta = materialize(metadata(docs), "meta")
    p = Plan(meta, shards, law).ranked(meta)
    return p.select(
        F.col("_id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("h").cast("int").alias("hilbert")
    )
