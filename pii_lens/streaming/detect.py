"""Detection on a stream of documents. It is row by row, so a stream goes through the same operator as a table does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.detect import allowed, detect
from ..plans.catalog import RECOGNIZERS, Recognizer


def documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_spans(stream: DataFrame, out: str, checkpoint: str, recognizers: tuple[Recognizer, ...] = RECOGNIZERS, once: bool = False):
    """Spans of the stream as Parquet; the file sink commits each micro-batch once, also when one runs again."""
    writer = allowed(detect(stream, recognizers)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
