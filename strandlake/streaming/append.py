"""Incremental ingest: NDJSON files that arrive in a folder become rows of the long measurement table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandlake.sources import records


def measurement_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The kept measurements of all files that arrive; stateless, so no watermark is needed."""
    lines = spark.readStream.format("text").schema("value string").load(folder)
    return records.measurements(records.parse_records(lines)).where("drop_reason is null").drop("drop_reason")


def append_measurements(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet and stop; files that were read are not read again (exactly once through the checkpoint)."""
    return measurement_stream(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
