"""Extraction, resolution and linking of tables of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .. import ship
from ..functions.keys import key
from ..functions.urls import url
from ..schema import CITATION, Options, table
from ..sources.registry import SEED, Registry
from . import authorities as au
from .aliases import apply_aliases
from .classify import is_ambiguous
from .find import authority_list, find
from .parallel import group
from .resolve import authorities, resolve_rows

SCHEMA = table(CITATION)
FIELD_NAMES = [f.name for f in SCHEMA["fields"].dataType.fields]
NOTES = "array<struct<number:int,start:int,end:int,sequence:int>>"


def read(text: str, o: Options, g: Registry = SEED, notes: list[dict] | None = None, wanted: frozenset[str] = frozenset(("key", "authority_cluster", "url"))) -> list[dict]:
    """All stages over one text: found, grouped, keyed, resolved, clustered, filtered; keys, clusters and addresses only if wanted."""
    citations = find(text, g, o, notes)
    if o.skip_authority_lists:
        listed = authority_list(text, citations)
        citations = [c for c in citations if c["index"] not in listed]
    if o.parallel:
        group(text, citations, g)
    for c in citations if "key" in wanted or "authority_cluster" in wanted else ():
        c["key"] = key(c, g) if not is_ambiguous(c) else None
    by = {c["index"]: c for c in citations}
    if o.resolve:
        for r in resolve_rows(citations, notes, g, check_locators=o.locators, linking=o.supra_linking_mode):
            by[r["index"]] |= {"antecedent": r["antecedent"], "antecedent_reason": r["reason"]}
        for k, members in enumerate(authorities(citations, g) if "authority_cluster" in wanted else ()):
            for i in members:
                by[i]["authority_cluster"] = k
    for c in citations if "url" in wanted else ():
        c["url"] = url(c if c["form"] == "full" or c["antecedent"] is None else by[c["antecedent"]], o.language, g) if c["form"] == "full" or c["antecedent"] is not None else None
    if o.source_only:
        citations = [c for c in citations if c["form"] != "full" or (c["jurisdiction"] or "").startswith("us") and c["style"]]
    # filters come last: what they drop may still be an antecedent
    return [c for c in citations if (not o.remove_ambiguous or not is_ambiguous(c)) and (o.authorities is None or c["authority"] in o.authorities or c["form"] != "full") and (o.forms is None or c["form"] in o.forms)]


def schema_for(id_type: T.DataType, columns: tuple[str, ...] | None = None) -> T.StructType:
    """The schema CITATION, or some of its columns (fields.note: of fields only note), with ids of a type, and a column for what went wrong."""
    if columns is not None and (unknown := set(columns) - set(SCHEMA.names) - {"error"} - {f"fields.{n}" for n in FIELD_NAMES}):
        raise ValueError(f"invalid_request: unknown columns: {sorted(unknown)}")
    kept = [f for f in SCHEMA.fields[1:] if columns is None or f.name in columns]
    parts = [f for f in SCHEMA["fields"].dataType.fields if columns is not None and f"fields.{f.name}" in columns]
    if parts and "fields" not in columns:
        kept.append(T.StructField("fields", T.StructType(parts)))
    return T.StructType([T.StructField("doc_id", id_type), *kept, T.StructField("error", T.StringType())])


#: Citations that a Python worker holds before it passes them on.
HELD = 2000
#: Texts and their notes that it holds as Python objects.
SLICE = 500

#: Bytes of texts for a core, under which they are dealt out anew before they are read: to a part for each core, and to several.
SPREAD, SEVERAL = 8 << 20, 128 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all cores where they are so few that their files would keep only some cores busy; reading a text costs far more than moving it."""
    if rows.isStreaming:
        return rows
    n = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(n if size < n * SPREAD else 4 * n) if size < n * SEVERAL else rows


def notes_of(column: pa.ListArray) -> Iterator[list[dict] | None]:
    """The notes of each text, from a column of type NOTES."""
    flat, at = list(zip(*(c.to_pylist() for c in column.flatten().flatten()), strict=True)), 0
    for n in pc.list_value_length(column).to_pylist():
        yield None if n is None else [{"number": i, "start": s, "end": e, "sequence": q} for i, s, e, q in flat[at : at + n]]
        at += n or 0


def extract(docs: DataFrame, notes: DataFrame | str | None = None, options: Options | None = None, registry: Registry = SEED, id_col: str = "doc_id", text_col: str = "text", on_error: str = "record", aliases: DataFrame | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each citation of each document, in the schema CITATION; ids keep their type.

    columns: those of the schema to make, beside doc_id and error; the others cost time and memory in Python too.

    notes: doc_id, number, start, end, sequence; or the name of a column of docs that has a text's notes as an
    array of number, start, end, sequence, in this order, which spares the join. on_error: "record" gives a text that can't be read one row
    with its id and the error, and nothing else; "raise" ends the job. aliases: written, key, court (see
    apply_aliases); with them there is a column alias_key, which counts go by, unless options.alias_keys is
    false. The map has no shuffle but for the joins with notes and aliases; each text is read by itself.
    """
    if on_error not in ("record", "raise"):
        raise ValueError(f"on_error is record or raise, not {on_error!r}")
    ship(docs.sparkSession)
    o = options or Options()
    if columns is not None and aliases is not None:
        columns = (*columns, "span", "key", "court")
    schema = schema_for(docs.schema[id_col].dataType, columns)
    names = schema.names[1:-1]
    plain, wanted = [n for n in names if n != "fields"], frozenset(names)
    parts = schema["fields"].dataType.names if "fields" in wanted else []
    arrow = to_arrow_schema(schema)
    within = F.col(f"`{notes}`") if isinstance(notes, str) else F.lit(None)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), within.cast(NOTES).alias("notes"))
    if notes is not None and not isinstance(notes, str):
        rows = rows.drop("notes")
        n = notes.groupBy(F.col("doc_id").alias("_d")).agg(F.sort_array(F.collect_list(F.struct("number", "start", "end", F.coalesce("sequence", F.lit(0)).alias("sequence")))).cast(NOTES).alias("notes"))
        rows = rows.join(n, F.col("doc_id") == F.col("_d"), "left").drop("_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            out = []
            for doc, text, note in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), notes_of(b.column(2)), strict=True):
                if not text:
                    continue
                try:
                    found = read(text, o, registry, note, wanted)
                except Exception as e:  # one text need not end the job, but it leaves a trace
                    if on_error == "raise":
                        raise
                    out.append({"doc_id": doc, "error": f"{type(e).__name__}: {e}"})
                    continue
                for c in found:
                    row = {n: c[n] for n in plain}
                    row["doc_id"] = doc
                    if "fields" in wanted:
                        row["fields"] = {k: c["fields"].get(k) for k in parts}
                    out.append(row)
                if len(out) >= HELD:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    found = spread(rows).mapInArrow(run, schema)
    if aliases is None:
        return found
    told = apply_aliases(found.withColumn("core", F.col("span.text")).withColumn("_court", F.col("court")).withColumn("court", F.col("court.id")), aliases, o.alias_keys)
    return told.withColumn("court", F.col("_court")).drop("core", "_court")


#: Columns of citations that resolution uses.
RESOLVED = ("index", "form", "authority", "format", "span", "full_span", "style", "parties", "fields", "court", "jurisdiction", "pinpoints", "parentheticals", "short_name", "explicit_short_name", "parallel_group", "key")
#: Extents that are sent to all executors; more are joined by shuffles.
FEW = 500_000


def resolve(citations: DataFrame, notes: DataFrame | None = None, registry: Registry = SEED, extents: DataFrame | None = None, linking: str = "safe") -> DataFrame:
    """doc_id, index, antecedent, reason of every citation that is not full.

    extents: key, last_page, paragraphs: sizes of works that the host knows; each citation gets that of its
    key, and references to places beyond them are refused. A document's citations and notes meet in one row, so that batches of documents go to Python and not one
    group at a time. The citations are read once; of their columns those in RESOLVED are used.
    """
    ship(citations.sparkSession)
    needed = [F.col(c) for c in RESOLVED if c in citations.columns]
    id_kind = citations.schema["doc_id"].dataType
    rows, check = citations.where("index is not null"), extents is not None
    if check:
        known = extents.groupBy(F.col("key").alias("_key")).agg(F.first(F.struct("last_page", "paragraphs")).alias("_size"))
        if known.limit(FEW + 1).count() <= FEW:
            known = F.broadcast(known)
        rows = rows.join(known, F.col("key") == F.col("_key"), "left")
        needed.append(F.col("_size").alias("size"))
    rows = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*needed)).alias("c"))
    if notes is None:
        rows = rows.withColumn("n", F.lit(None).cast(NOTES))
    else:
        n = notes.groupBy("doc_id").agg(F.collect_list(F.struct("number", "start", "end", F.coalesce("sequence", F.lit(0)).alias("sequence"))).cast(NOTES).alias("n"))
        rows = rows.join(n, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, found, note in zip(*(c.to_pylist() for c in b.columns), strict=True):
                known = {c["key"]: c["size"] for c in found if c["size"]} if check else {}
                out += [(doc, r["index"], r["antecedent"], r["reason"]) for r in resolve_rows(found, note, registry, known, check, linking)]
            if out:
                kinds = (to_arrow_type(id_kind), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "index", "antecedent", "reason"])

    return rows.mapInArrow(run, f"doc_id {id_kind.simpleString()}, index int, antecedent int, reason string")


def clusters(citations: DataFrame) -> DataFrame:
    """doc_id, cluster, members, representative, name: the authorities of each document."""
    m = citations.where("authority_cluster is not null")
    g = m.groupBy("doc_id", F.col("authority_cluster").alias("cluster")).agg(
        F.array_sort(F.collect_list("index")).alias("members"),
        F.min(F.when(F.col("form") == "full", F.struct(F.col("key").isNull().alias("k"), F.col("index").alias("i"), F.coalesce("short_name", "span.text").alias("name")))).alias("r"),
    )
    return g.select("doc_id", "cluster", "members", F.col("r.i").alias("representative"), F.col("r.name").alias("name"))


def citation_counts(citations: DataFrame) -> DataFrame:
    """key, citations, documents: how often each authority is cited, back references included.

    A reference counts for its antecedent's key. The citations are read once: each row stands at its own place in its
    document, each reference at its antecedent's too, and what stands at one place meets in one aggregation.
    """
    if "alias_key" in citations.columns:
        citations = citations.withColumn("key", F.col("alias_key"))
    own = F.when(F.col("key").isNotNull(), F.struct(F.col("index").alias("at"), F.col("key").alias("key"), F.lit(0).alias("back")))
    back = F.when(F.col("antecedent").isNotNull() & F.col("doc_id").isNotNull(), F.struct(F.col("antecedent").alias("at"), F.lit(None).cast("string").alias("key"), F.lit(1).alias("back")))
    placed = citations.select("doc_id", F.explode(F.array_compact(F.array(own, back))).alias("p")).select("doc_id", "p.at", "p.key", "p.back")
    met = placed.groupBy("doc_id", "at").agg(F.collect_list("key").alias("keys"), F.sum("back").alias("back"))
    every = met.select("doc_id", F.explode("keys").alias("key"), (F.col("back") + 1).alias("n"))
    per = every.groupBy("key", "doc_id").agg(F.sum("n").alias("n"))
    return per.groupBy("key").agg(F.sum("n").alias("citations"), F.count(F.lit(1)).alias("documents"))


def top_cited(citations: DataFrame, k: int = 10) -> DataFrame:
    return citation_counts(citations).orderBy(F.col("citations").desc(), "key").limit(k)


caption_style_of_cause = au.caption_style_of_cause
