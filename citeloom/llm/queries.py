"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, hmm, langid, mixing, neardup, quality, secrets, sharding, tokens, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": lambda s, d: secrets.digest(_read(s, d, "documents")),
    "op2_quality_rules": lambda s, d: quality.digest(_read(s, d, "documents")),
    "op3_decontamination": lambda s, d: decontam.digest(_read(s, d, "documents"), _read(s, d, "benchmark")),
    "op4_mixing": lambda s, d: mixing.digest(_read(s, d, "documents")),
    "op5_token_output": lambda s, d: tokens.digest(_read(s, d, "documents")),
    "op6_sharding": lambda s, d: sharding.digest(_read(s, d, "documents")),
    "op7_lm_scoring": lambda s, d: hmm.digest(_read(s, d, "documents")),
    "op8_warc": lambda s, d: warc.digest(_read(s, d, "pages")),
    "op9_near_dedup": lambda s, d: neardup.digest(_read(s, d, "documents")),
    "op10_language_id": lambda s, d: langid.digest(_read(s, d, "documents")),
}

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), occ AS (
  SELECT doc_id, pos.n, i, item FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1
), items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM occ GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 4) AS INTEGER) AS step
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS cap, CAST(CASE place % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, place_key) AS k FROM (SELECT *, coalesce(source, '~') AS place_key FROM w)
), c AS (
  SELECT k, cap, weight, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM o
), level AS (
  SELECT CAST(num AS DOUBLE) AS num, den FROM c WHERE weight * CAST(num AS DOUBLE) <= cap * den ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least(weight * num / den, CAST(cap AS DOUBLE)) AS target FROM w, level
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), st AS (
  SELECT source, step, sum(size) AS n FROM d GROUP BY source, step
), b AS (
  SELECT source, step, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st
), f AS (
  SELECT b.source, b.step, r.source_size, r.target, least(whole + CASE WHEN before + n / 2 <= target - whole * source_size THEN 1 ELSE 0 END, 3) AS times
  FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
)
SELECT d.doc_id, d.size, f.source_size, f.target, CAST(d.size * f.times AS BIGINT) AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.step = f.step
"""

OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
  CASE WHEN n >= 100 AND m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND m IS NOT NULL AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""

ORACLE_SQL: dict[str, str] = {"op3_decontamination": OP3_SQL, "op4_mixing": OP4_SQL, "op8_warc": OP8_SQL}
