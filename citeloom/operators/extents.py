"""Known sizes of works: a text table of delta-coded lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

SCHEMA = "key string, last_page int, paragraphs int, sec_lo int, sec_hi int"


def decode(lines: list[str]) -> list[dict]:
    """Rows of ``N court year gaps``, ``V volume gaps`` and ``S key lo:hi``; the last row of a key wins."""
    out: dict[str, dict] = {}
    for line in lines:
        parts = line.rstrip("\n").split("\t")
        if parts[0] == "N" and len(parts) >= 4:
            n = 0
            for i, gap in enumerate(x for x in parts[3].split(",") if x):
                step, _, size = gap.partition(":")
                n += int(step)
                k = f"4:neutral:{parts[2]}:{parts[1]}:{n}"
                out[k] = {"key": k, "last_page": None, "paragraphs": int(size) if size else None, "sec_lo": None, "sec_hi": None}
        elif parts[0] == "V" and len(parts) >= 3:
            n, pages = 0, []
            for gap in (x for x in parts[2].split(",") if x):
                n += int(gap)
                pages.append(n)
            for a, b in zip(pages, [*pages[1:], None], strict=True):
                k = f"{parts[1]}:{a}"
                out[k] = {"key": k, "last_page": b - 1 if b else None, "paragraphs": None, "sec_lo": None, "sec_hi": None}
        elif parts[0] == "S" and len(parts) >= 3:
            lo, _, hi = parts[2].partition(":")
            out[parts[1]] = {"key": parts[1], "last_page": None, "paragraphs": None, "sec_lo": int(lo), "sec_hi": int(hi)}
    return list(out.values())


def volumes(lines: DataFrame) -> DataFrame:
    """lines (value) of kind V → key, last_page, as columns: the running sums of the gaps."""
    parts = F.split("value", "\t")
    v = lines.where(F.col("value").startswith("V\t")).select(parts[1].alias("volume"), F.transform(F.split(parts[2], ","), lambda x: x.cast("int")).alias("gaps"))
    each = v.select("volume", F.posexplode("gaps").alias("i", "gap"), "gaps")
    page = F.expr("aggregate(slice(gaps, 1, i + 1), 0, (s, x) -> s + x)")
    nxt = F.expr("if(i + 1 < size(gaps), aggregate(slice(gaps, 1, i + 2), 0, (s, x) -> s + x) - 1, null)")
    return each.select(F.concat_ws(":", "volume", page.cast("string")).alias("key"), nxt.cast("int").alias("last_page"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The sizes in a file; of equal keys the last line wins."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    rows = lines.mapInPandas(lambda it: _rows(it), f"{SCHEMA}, at long")
    w = Window.partitionBy("key").orderBy(F.col("at").desc())
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "at")


def _rows(batches):
    import pandas as pd

    for b in batches:
        out = [{**r, "at": at} for line, at in zip(b["value"], b["at"], strict=True) for r in decode([line])]
        frame = pd.DataFrame(out, columns=["key", "last_page", "paragraphs", "sec_lo", "sec_hi", "at"])
        for c in ("last_page", "paragraphs", "sec_lo", "sec_hi"):
            frame[c] = frame[c].astype("Int32")
        yield frame
