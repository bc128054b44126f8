"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong spans are found by three patterns. Weak parts of a credential (an identifier, a secret, an
endpoint) are reported only where complementary parts lie together: in one scope (a stretch of text
without a blank line) and at most ``REACH`` code points apart (three lines of 80: configuration blocks name
the parts of one credential on neighbouring lines). The link is an interval join of the parts, made as a
sweep with running extremes in each scope, so that every link counts and no pairs are emitted.

Null and empty texts have no spans. Rows are never merged: repeated rows give repeated results. A null
id is an id like any other. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs with the least length: the same spans as all runs less those that are too short.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Keys may have a prefix that ends in _ or -; the access key after "secret" is no identifier.
IDENT = r"""(?i)(?<![A-Za-z0-9])(?:(?<!secret[_-])access_?key(?:_?id)?|client_?id|account|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
WEAK = r"""(?i)(?<![A-Za-z0-9])(?:pwd|pass|private_?key|secret_?(?:access_?)?key|credential|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@%^-]{6,}"""
KEY40 = r"(?<![A-Za-z0-9+/])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"""(?i)\b(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+|(?<![A-Za-z0-9])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}"""
BREAK = r"\n[\x20\t\r]*\n"
#: In the order of ties.
KINDS = ("assign", "access", "hex", "ident", "weak_secret", "key40", "endpoint", "break")
BASE = KINDS[:3]
#: What complements a part: identifiers and endpoints need a secret, secrets one of those.
SECRET_SIDE = ("assign", "weak_secret", "key40")
PARTNER_SIDE = ("access", "ident", "endpoint")
REACH = 240


def _pieces(text: Column, pattern: str, kind: str, when: Column, group: int = 0, least: int = 0) -> Column:
    """One struct for each match: its number, the code points before it since the last match, its own, whether it counts."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(matches, lambda m: F.length(m))
    judged = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)) if group else lengths
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    zipped = F.transform(
        F.arrays_zip(gaps.alias("g"), lengths.alias("m"), judged.alias("j")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), x["g"].alias("gap"), x["m"].alias("len"), (x["j"] >= least).alias("ok")),
    )
    none = F.array().cast("array<struct<kind:string,n:int,gap:int,len:int,ok:boolean>>")
    return F.when(when, F.filter(zipped, lambda x: x["len"].isNotNull())).otherwise(none)


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each candidate span and one, without kind, for each document: _id, _h, _n, kind, start, end."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    t = F.col("_t")
    pairs = F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    header = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(True).alias("ok")))
    weak = F.concat(
        _pieces(t, IDENT, "ident", pairs & t.rlike(IDENT)),
        _pieces(t, WEAK, "weak_secret", pairs & t.rlike(WEAK)),
        _pieces(t, KEY40, "key40", t.rlike(r"[A-Za-z0-9+/]{40}")),
        _pieces(t, ENDPOINT, "endpoint", pairs & t.rlike(ENDPOINT)),
    )
    strong = F.concat(
        _pieces(t, ASSIGN, "assign", pairs & t.rlike(ASSIGN), 2, 6),
        _pieces(t, ACCESS, "access", F.contains(t, F.lit("AKIA"))),
        _pieces(t, HEX, "hex", t.rlike(HEX)),
    )
    found = rows.select("_id", F.xxhash64("_t").alias("_h"), F.length("_t").alias("_l"), strong.alias("_s"), weak.alias("_w"), F.when(F.contains(t, F.lit("\n")), t).alias("_t"))
    # scopes matter only where something weak was found
    scopes = _pieces(F.col("_t"), BREAK, "break", F.col("_t").isNotNull() & (F.size("_w") > 0))
    each = found.select("_id", "_h", "_l", F.explode(F.concat(header, "_s", "_w", scopes)).alias("c")).select("_id", "_h", "_l", "c.*")
    key = ["_id", "_h", "_l"]
    # equal rows have equal spans: they are counted, and dealt out again at the end
    once = each.groupBy(*key, "kind", "n", "gap", "len", "ok").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*key, "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(run)
    return once.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("ok").select(*key, "_n", "kind", "start", "end")


def linked_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = REACH) -> DataFrame:
    """All spans to report, with a row without kind for each distinct document: _id, _h, _l, _n, kind, start, end.

    Of all partners that begin before a part, in its scope, the greatest end tells whether one is near; of
    those that begin after it, the least start does. Where reach is None the scope alone bounds a link.
    """
    c = _candidates(docs, id_col, text_col)
    key = ["_id", "_h", "_l"]
    order = ("start", "end", "kind")
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("scope", F.sum((F.col("kind") == "break").cast("int")).over(upto))
    scope = Window.partitionBy(*key, "scope").orderBy(*order)
    before, after = scope.rowsBetween(Window.unboundedPreceding, -1), scope.rowsBetween(1, Window.unboundedFollowing)
    near = F.lit(False)
    for mine, theirs in ((SECRET_SIDE, PARTNER_SIDE), (PARTNER_SIDE, SECRET_SIDE)):
        there = F.col("kind").isin(*theirs)
        gaps = F.col("start") - F.max(F.when(there, F.col("end"))).over(before), F.min(F.when(there, F.col("start"))).over(after) - F.col("end")
        close = [g.isNotNull() if reach is None else F.coalesce(g <= reach, F.lit(False)) for g in gaps]
        c = c.withColumn(f"_near_{mine[0]}", F.col("kind").isin(*mine) & (close[0] | close[1]))
        near = near | F.col(f"_near_{mine[0]}")
    keep = F.col("kind").isNull() | F.col("kind").isin(*BASE) | ((F.col("kind") != "break") & near)
    return c.where(keep).select(*key, "_n", "kind", "start", "end")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = REACH) -> DataFrame:
    """A row for each row of docs: its id and its spans, ordered by start and kind.

    Columns: the id, spans (array of start, rank, end, kind), base (those of the strong patterns).
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    span = F.when(F.col("kind").isNotNull(), F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.col("kind")))
    g = linked_spans(docs, id_col, text_col, reach).groupBy("_id", "_h", "_l").agg(F.max(F.when(F.col("kind").isNull(), F.col("_n"))).alias("_n"), F.array_sort(F.collect_list(span)).alias("spans"))
    g = g.withColumn("base", F.filter("spans", lambda s: s["rank"] < len(BASE)))
    return g.select(F.col("_id").alias(id_col), "spans", "base", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))).alias("_i")).drop("_i")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    s = scan_secrets(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return s.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_linked"),
    )
