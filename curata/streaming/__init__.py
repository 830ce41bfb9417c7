"""Apply fitted operators to Structured Streaming inputs.

The reference has no streaming; what carries over is its learned steps:
parameters are fitted once on a table (``curata.operators.*.fit_*``), then
``Fitted.transform`` -- column expressions, or a stream-static join for label
codes -- runs on every micro-batch.  No operator here keeps streaming state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from curata.operators.fitted import Fitted


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream with a fixed schema (no inference on a stream)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def transform_stream(df: DataFrame, steps: Sequence[Fitted]) -> DataFrame:
    """Apply fitted steps in order (works on batch and streaming frames)."""
    for step in steps:
        df = step.transform(df)
    return df


def write_stream(
    df: DataFrame,
    path: str,
    checkpoint_location: str,
    fmt: str = "parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """Append the stream to files; the checkpoint gives exactly-once output
    across restarts.  ``available_now`` processes what is there and stops."""
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint_location)
    writer = writer.outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
