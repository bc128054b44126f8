"""Extraction over streams: a stateless map of each document, so that it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract
from ..schema import Options

DOCUMENT = "doc_id long, text string"


def stream_documents(spark: SparkSession, path: str, schema: str = DOCUMENT, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_extract(documents: DataFrame, sink: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Citations of a stream of documents to Parquet files, exactly once, until all that is there is read."""
    return extract(documents, options=options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
