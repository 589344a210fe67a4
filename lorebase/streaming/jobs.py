"""Jobs as event streams: sequence numbers, latest states and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import clamp


def event_seq(events: DataFrame) -> DataFrame:
    """STR-04, WIN-07: events (job_id, ts, event_id, ...) with seq_no per job."""
    return events.withColumn("seq_no", F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "event_id")))


def latest_state(events: DataFrame) -> DataFrame:
    """STR-02: each job's last status, its time and how many events it had; one
    aggregation, the same in batch and in a stream."""
    last = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(F.max_by("status", last).alias("status"), F.max("ts").alias("ts"), F.count("*").alias("events"))


def progress(events: DataFrame) -> DataFrame:
    """STR-03: progress within [0, 1]."""
    return events.withColumn("progress", clamp(F.col("progress")))


def read_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def maintain_states(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """STR-01/06: the latest states of every micro-batch go to ``sink``; what has
    arrived is processed and the query ends. STR-05: stop() cancels it."""
    return latest_state(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def ingest_files(spark: SparkSession, path: str, schema: StructType, checkpoint: str, table: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """New files of a folder, through ``transform``, appended to a Parquet table;
    each file is taken once."""
    return transform(spark.readStream.schema(schema).parquet(path)).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(table)
