"""Relational forms of the engine's ordered rules: overlaps, islands, as-of and ranked choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy(rows: DataFrame, by: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Of overlapping intervals of a group those kept: by start, longest first, each that begins at or after the last *kept* end.

    A running maximum of ends would be wrong, since a dropped interval must not block later ones; the fold
    goes over one group's sorted array.
    """
    item = F.struct(F.col(start).alias("s"), (-F.col(end)).alias("e"), F.col(tie).alias("t"))
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("a"))
    empty = F.struct(F.lit(-(1 << 62)).cast("long").alias("last"), F.array().cast("array<struct<s:long,e:long,t:long>>").alias("kept"))
    step = lambda acc, x: F.when(
        x["s"] >= acc["last"], F.struct((-x["e"]).cast("long").alias("last"), F.concat(acc["kept"], F.array(F.struct(x["s"].cast("long").alias("s"), x["e"].cast("long").alias("e"), x["t"].cast("long").alias("t")))).alias("kept"))
    ).otherwise(acc)
    return g.select(*by, F.explode(F.aggregate("a", empty, step, lambda acc: acc["kept"])).alias("k")).select(*by, F.col("k.s").alias(start), (-F.col("k.e")).alias(end), F.col("k.t").alias(tie))


def clamped(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Intervals in order, each begun at the end of those before it; one of which nothing is left goes."""
    before = F.max(end).over(Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(start, F.greatest(F.col(start), F.coalesce(before, F.lit(0)))).where(F.col(start) < F.col(end))


def islands(rows: DataFrame, by: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Intervals with at most gap between them as one: by, start, end, n."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = rows.withColumn("_b", F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0))
    return first.withColumn("_i", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_i")


def within(points: DataFrame, ranges: DataFrame, by: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """points joined with the ranges that hold them: an equi-join on (by, bucket of width), then the exact test."""
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width))))
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return p.join(r, [by, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def previous(rows: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The value of the row before, null included: a null is a barrier and not skipped."""
    return rows.withColumn(name, F.lag(value).over(Window.partitionBy(*by).orderBy(order)))


def unique_best(rows: DataFrame, by: list[str], score: Column) -> DataFrame:
    """Of each group the one row of least score, or none where several have it."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_s", score).withColumn("_m", F.min("_s").over(w)).where(F.col("_s") == F.col("_m"))
    return r.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").drop("_s", "_m", "_n")


def drift_mode(rows: DataFrame, by: str, stated: str, actual: str) -> DataFrame:
    """by, drift: the most common difference, if at least two and half of the rows share it; of equals the least."""
    n = rows.groupBy(by, (F.col(actual) - F.col(stated)).alias("drift")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    ranked = n.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("n").desc(), F.abs("drift"), "drift")))
    return ranked.where("r = 1 and n >= 2 and 2 * n >= total").select(by, "drift")
