"""Documents from files, and results to files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """A row for each file: doc_id, file, text."""
    rows = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return rows.withColumn("doc_id", F.xxhash64("file"))


def json_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A row for each line that is not blank: doc_id, file, line, text, rest (the object's other keys as JSON).

    A line is a JSON string or an object with text. Where strict, a bad line ends the job with its number.
    line counts lines within a file.
    """
    # large files are split; a block's first line number comes from the counts of the blocks before it
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("raw"))
    counts = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    raw = raw.join(counts, ["file", "block"]).withColumn("line", (F.col("before") + F.col("m") - F.col("first") + 1).cast("int")).where(F.trim("raw") != "")
    text = F.coalesce(F.get_json_object("raw", "$.text"), F.when(F.trim("raw").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), F.col("raw"), F.lit("}")), "$.v")))
    rows = raw.select("file", "line", text.alias("text"), F.when(F.trim("raw").startswith("{"), F.col("raw")).alias("rest"))
    if strict:
        rows = rows.withColumn("text", F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("invalid_request: line "), F.col("line").cast("string")))))
    return rows.withColumn("doc_id", F.xxhash64("file", "line"))


def batch(lines: DataFrame, call: Callable[[str, dict], object]) -> DataFrame:
    """lines (value: {"id", "method", "request"}) → id, result or error as JSON; a bad line gives an error and no end."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for v in b["value"]:
                if not (v or "").strip():
                    continue
                ident = None
                try:
                    r = json.loads(v)
                    ident = r.get("id")
                    out.append((None if ident is None else str(ident), json.dumps(call(r["method"], r.get("request") or {}), ensure_ascii=False), None))
                except Exception as e:  # the line's own error is its result
                    out.append((None if ident is None else str(ident), None, json.dumps({"code": str(e).split(":")[0] if str(e).startswith("invalid") else "invalid_request", "message": str(e)}, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["id", "result", "error"])

    return lines.mapInPandas(run, "id string, result string, error string")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
