"""The native lane: families with regular patterns read by columns alone, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import neutral_key, reporter_key
from ..functions.text import fold_column, spans_column
from ..sources.registry import SEED, Registry, surface_rows

# Fixed patterns of the native lane, with numbered groups.
NEUTRAL = r"(?<![\w.\-/])(\[)?((?:1[6-9]|20|21)\d{2})\]?\s+([A-Z]{2,9}(?:\s(?:Civ|Crim))?)\s+(\d{1,9})(?![\w(])"
REPORT = r"(?<![\w.\-/])(?:\[((?:1[6-9]|20|21)\d{2})\]\s*)?(?:(\d{1,4})\s+)?((?:S\.?C\.?R|D\.?L\.?R|C\.?C\.?C|O\.?R|A\.?C|U\.S|F|F\. Supp)\.?(?:\s?\(?[2-6](?:d|th)\)?)?)\s+(\d{1,5})(?![\w(])"
CANLII = r"(?<![\w.\-/])((?:1[6-9]|20|21)\d{2})\s+CanLII\s+(\d+)"
DATABASE = r"(?<![\w.\-/])\[?((?:1[6-9]|20|21)\d{2})\]?\s+(Carswell[A-Z]\w*|[A-Z]{1,3}J No|WL)\s+(\d+)"
STATUTE = r"(?<![\w.\-/])((?:R\.?S\.?C|S\.?C|L\.?R\.?C|L\.?C|R\.?S\.?O|S\.?O)\.?)\s+((?:1[6-9]|20)\d{2}),?\s+ch?\.?\s+([A-Z]*[-.]?\d(?:[\w.\-]*\w)?)"
REGULATION = r"(?<![\w.\-/])(SOR|DORS|SI|TR)/(\d{2,4}-\d+)|(O\.? Reg\.?) (\d+/\d{2,4})"
US_CODE = r"(?<![\w.\-/])(\d+)\s+U\.S\.C\.\s+§§?\s*(\d[\w.()-]*)"
BACK = r"\b([Ii]bid|[Ss]upra note \d+|[Ss]upra)\b"
SECTION = r"§§?\s*\d[\w.()-]*"


def matches(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, start, end, text of each match; docs that can't match give no rows."""
    return docs.where(F.col("text").rlike(pattern)).select("doc_id", F.explode(spans_column(F.col("text"), pattern)).alias("m")).select("doc_id", "m.start", "m.end", F.col("m.text").alias("core"))


def spelled(registry: Registry, table: str) -> Column:
    """A map from folded spelling to the entries that have it: a constant in the plan, since the registry is of fixed size."""
    rows: dict[str, list[Column]] = {}
    for r in surface_rows(registry, table):
        rows.setdefault(r["surface"], []).append(F.struct(*[F.lit(r[k]).cast(t).alias(k) for k, t in (("id", "string"), ("jurisdiction", "string"), ("canonical", "string"), ("year_volume", "boolean"))]))
    return F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), F.array(*v))])


def ranked(jurisdiction: Column, priority: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when((jurisdiction == p) | jurisdiction.startswith(p + "-"), F.lit(i)) for i, p in enumerate(priority)], F.lit(len(priority)))


def only_best(candidates: Column, score) -> Column:
    """The candidate of least score, null where two have it: in the row, without a shuffle."""
    scored = F.array_sort(F.transform(candidates, lambda c: F.struct(score(c).alias("s"), c["id"].alias("id"), c["jurisdiction"].alias("jurisdiction"), c["canonical"].alias("canonical"), c["year_volume"].alias("year_volume"))))
    first, second = F.get(scored, F.lit(0)), F.get(scored, F.lit(1))
    return F.when((F.size(scored) == 1) | (first["s"] < second["s"]), first)


def neutral_citations(docs: DataFrame, registry: Registry = SEED, priority: tuple[str, ...] = ("ca",)) -> DataFrame:
    """doc_id, start, end, core, year, code, number, court, jurisdiction, key of neutral citations.

    Brackets around the year speak for a court outside Canada; then the order of jurisdictions counts; of
    several courts with the least score none is chosen. A plan of scans and projections only.
    """
    m = matches(docs, NEUTRAL)
    g = lambda i: F.regexp_extract("core", NEUTRAL, i)
    m = m.select("doc_id", "start", "end", "core", (g(1) != "").alias("bracketed"), g(2).alias("year"), g(3).alias("code"), g(4).alias("number"))
    m = m.withColumn("found", F.element_at(spelled(registry, "codes"), fold_column(F.col("code")))).where("found is not null")
    best = only_best(F.col("found"), lambda c: F.struct((F.col("bracketed") == c["jurisdiction"].startswith("ca")).alias("form"), ranked(c["jurisdiction"], priority).alias("place")))
    b = m.withColumn("best", best).select("doc_id", "start", "end", "core", "year", "code", "number", F.col("best.id").alias("court"), F.col("best.jurisdiction").alias("jurisdiction"))
    return b.withColumn("key", neutral_key(F.col("year"), F.col("court"), F.col("number")))


def reports(docs: DataFrame, registry: Registry = SEED, priority: tuple[str, ...] = ("ca",)) -> DataFrame:
    """doc_id, start, end, core, year, volume, reporter, page, reporter_id, edition, key of reports; a plan without shuffle."""
    m = matches(docs, REPORT)
    g = lambda i: F.regexp_extract("core", REPORT, i)
    m = m.select("doc_id", "start", "end", "core", F.nullif(g(1), F.lit("")).alias("year"), F.nullif(g(2), F.lit("")).alias("volume"), F.trim(g(3)).alias("reporter"), g(4).alias("page")).where("year is not null or volume is not null")
    m = m.withColumn("found", F.element_at(spelled(registry, "reporters"), fold_column(F.col("reporter")))).where("found is not null")
    best = only_best(F.col("found"), lambda c: F.struct(ranked(c["jurisdiction"], priority).alias("place"), (F.col("year").isNotNull() != c["year_volume"]).alias("form")))
    m = m.withColumn("b", best).where("b is not null")
    key = reporter_key(F.col("b.id"), F.col("b.canonical"), F.col("b.year_volume"), F.col("year"), F.col("volume"), F.col("page"))
    return m.select("doc_id", "start", "end", "core", "year", "volume", "reporter", "page", F.col("b.id").alias("reporter_id"), F.col("b.canonical").alias("edition"), key.alias("key"))
