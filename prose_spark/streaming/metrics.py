"""Structured Streaming forms: stateless metrics and scans over arriving documents, windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback, readability


def document_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sentence_stream(documents: DataFrame, markdown: bool = True) -> DataFrame:
    """Sentences of arriving documents, append mode, no state."""
    return readability.sentence_rows(readability.split_blocks(documents, markdown))


def sensitive_stream(documents: DataFrame) -> DataFrame:
    return feedback.sensitive_scan(documents).filter("email + url + phone + long_number > 0")


def windowed_counts(events: DataFrame, time: str, by: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window; events later than the watermark are dropped, state is bounded by it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"))
