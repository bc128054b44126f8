"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import decontam, langid, mixing, neardup, tokens
from citeloom.llm.scratch import materialize, sized

#: Least score of a language for a document of LEAST_WORDS words or more to stay, and for a shorter one, whose few n-grams tell little.
LEAST_SCORE, LEAST_SHORT, LEAST_WORDS = 0.25, 0.05, 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those that resemble no language; lang is only learned from."""
    d = langid.fold(docs, "doc_id", 4)
    profiles = langid.learn(d.where(~F.col("_held")))
    judged = langid.annotate(docs, profiles, pred="__lang", score="__score")
    least = F.when(mixing.n_words(F.col("text")) >= LEAST_WORDS, LEAST_SCORE).otherwise(LEAST_SHORT)
    return judged.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= least)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the least id, of each class of near-duplicates."""
    return sized(neardup.deduplicated(docs), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a benchmark's passages make up a twentieth of or more."""
    return sized(decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return sized(mixing.mixed(docs), docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and write all documents; the rows of the files: doc_id, start, n_tokens, ids_crc32."""
    return tokens.digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

#: Order MinHash and rank-order profiles have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
