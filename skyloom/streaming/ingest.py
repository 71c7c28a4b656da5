"""Resumable ingestion of shards as a stream over arriving files.

The stream's checkpoint remembers which files are done, so a restart goes on
where the last run stopped; ``availableNow`` ends when all files present are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def observation_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append the stream to Parquet partitioned by ``key`` until the present files are done."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).partitionBy(key).format("parquet").outputMode("append").start(target)
