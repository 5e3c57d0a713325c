"""Append-only logs: written batch by batch, read as a stream, the latest record of each key kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.audit import latest


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def follow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def mirror(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Copies what is there into another log, exactly once, and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(queue: DataFrame, log: DataFrame, keys: list[str], order: str, retry_failed: bool = False) -> DataFrame:
    """The queue's rows without a finished record, or, to retry, those whose latest record failed."""
    last = latest(log, keys, order)
    return queue.join(last.where("status = 'failed'"), keys, "left_semi") if retry_failed else queue.join(last.where("status <> 'failed'"), keys, "left_anti")
