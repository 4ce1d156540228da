"""The scoring plan over a stream. It keeps no state: each row is scored by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosemill.operators.detect import detect

SUBMISSION = "id string, text string"


def submissions(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", max_files).json(path)


def score_stream(stream: DataFrame, output: str, checkpoint: str, available_now: bool = True, **options):
    """Starts a query that appends scores to a Parquet table."""
    writer = detect(stream, **options).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
