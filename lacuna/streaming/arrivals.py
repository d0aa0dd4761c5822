"""New files of a catalog, taken in as they arrive.

The series has no event-time logic: a month is complete or it isn't. So this is an
incremental batch, run until all present files are taken and then ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def take_new(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived since the last run to a Parquet table, each file exactly once."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
