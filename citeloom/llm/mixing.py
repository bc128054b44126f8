"""Mixing sources to target weights by capped water-filling.

Every source gets the share of its weight, at most ``max_epochs`` times its own size; what is above is
shared among the others in proportion to their weights until none is above. A source's documents are
then taken whole times, and once more for a seeded part of them that makes up the fraction.

Null sources are a source of their own; null texts have size 0. Sources of size 0 get target 0. An empty
table gives an empty result. Repeated rows are taken each for itself. Rerunning gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import join_counted, materialize, running

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Steps of the seeded order in which a source's documents are taken once more.
STEPS = 1 << 16
COARSE = 1 << 8


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    cut = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    trailing = F.when(F.element_at(cut, -1) == "", 1).otherwise(0)
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(cut) - trailing).cast("long")


def seeded_step(id_col: Column, text: Column, seed: int) -> Column:
    """A number from 0 to STEPS - 1 that depends on the seed, the id and the text."""
    told = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(told), 1, 4), 16, 10).cast("int")


def source_key(source: Column) -> Column:
    """A source, or null, as text that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source.cast("string")))


def ranked_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with weight: in code-point order, null last, the weights in turn."""
    placed = running(sources.withColumn("_one", F.lit(1)), "_one", F.col("source").asc_nulls_last(), name="_place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return placed.withColumn("weight", turn[(F.col("_place") % len(weights)).cast("int")]).drop("_one", "_place")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size, weight) with target.

    Each round sends three sums to the driver: of all sizes, of clamped sources' caps, of the others' weights.
    """
    total, den = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    cap, num, clamped = F.col("source_size") * max_epochs, total, 0
    while True:
        above = F.col("weight") * F.lit(float(num)) > cap * F.lit(float(den))
        n, caps, rest = sources.agg(F.sum(above.cast("long")), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if (n or 0) <= clamped:
            break
        clamped, num, den = n, total - (caps or 0), rest or 1.0
    given = F.col("weight") * F.lit(float(num)) / F.lit(float(den))
    return sources.withColumn("target", F.least(given, cap.cast("double")))


def plan_repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, size, source, source_size, target, times (whole repetitions taken).

    keep: columns of docs to carry along instead of only the id. Documents are ordered, within a source, by a
    seeded step; those of the first steps are taken once more until the fraction is made up, so that a source
    misses its target by one step's documents at most (a 65,536th of a large source).
    """
    carried = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep or [])]
    text = F.col(f"`{text_col}`")
    sized = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"), seeded_step(F.col(f"`{id_col}`"), text, seed).alias("_step"), *carried)
    if keep is None:
        sized = materialize(sized, "sizes")
        narrow = sized
    else:
        narrow = materialize(sized.select("source", "size", "_step"), "sizes")
    steps = materialize(narrow.groupBy("source", "_step").agg(F.sum("size").alias("step_size"), F.count(F.lit(1)).alias("n")), "steps", "fewer")
    sources = steps.groupBy("source").agg(F.sum("step_size").cast("long").alias("source_size"))
    targets = materialize(water_fill(materialize(ranked_weights(sources, weights), "sources", "fewer"), max_epochs), "targets", "fewer")
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # the words before each step of a source, from sums over coarse steps and then within one
    coarse = (F.col("_step") / COARSE).cast("int")
    by_coarse = steps.groupBy("source", coarse.alias("_coarse")).agg(F.sum("step_size").alias("c"))
    w = Window.partitionBy("source").orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    by_coarse = by_coarse.select(F.col("source").alias("s2"), F.col("_coarse").alias("c2"), F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c_before"))
    fine = steps.withColumn("_coarse", coarse)
    w = Window.partitionBy("source", "_coarse").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("f_before", F.coalesce(F.sum("step_size").over(w), F.lit(0)))
    fine = fine.join(by_coarse, F.col("source").eqNullSafe(F.col("s2")) & (F.col("_coarse") == F.col("c2"))).drop("s2", "c2")
    t = targets.select(F.col("source").alias("s3"), "source_size", "target", "whole", "rest")
    fine = fine.join(t, F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    # the last step is taken if that comes nearer to the target than leaving it; what comes before only grows, so that a source has one last step
    more = (F.col("c_before") + F.col("f_before") + F.col("step_size") / 2) <= F.col("rest")
    last = fine.groupBy("source", "source_size", "target", "whole").agg(F.max(F.when(more, F.col("_step"))).alias("_last"), F.sum("n").alias("n"))
    told = materialize(last.select(source_key(F.col("source")).alias("_key"), "source_size", "target", "whole", "_last", "n"), "plan", "fewer")
    out = join_counted(sized.withColumn("_key", source_key(F.col("source"))), told, "_key").withColumn("more", F.coalesce(F.col("_step") <= F.col("_last"), F.lit(False)).cast("int"))
    return out.drop("_key", "_step", "_last").withColumn("times", F.least(F.col("whole") + F.col("more"), F.lit(max_epochs)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    p = plan_repetitions(docs)
    return p.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it."""
    p = plan_repetitions(docs, id_col, text_col, source_col, keep=docs.columns, **how)
    p = p.withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return p.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)])
