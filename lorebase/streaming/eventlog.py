"""SNK-12, STR-06: events pushed once, though their batches may be replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


class EventLog:
    """A folder of Parquet batches and a ledger of those that are whole.

    A batch is written to a folder of its own number, over what a failed attempt
    left there, and then entered in the ledger by creating one empty file, which a
    store does as a whole or not at all. Readers see batches in the ledger only, so
    a replayed batch adds nothing and half a batch is never seen.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def committed(self) -> list[int]:
        fs, p = self._fs("_ledger")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def push(self, batch: DataFrame, number: int) -> bool:
        """Keeps a batch; False if it is there already."""
        fs, mark = self._fs(f"_ledger/{number}")
        if fs.exists(mark):
            return False
        batch.write.mode("overwrite").parquet(f"{self.path}/batches/{number}")
        fs.create(mark, False).close()
        return True

    def events(self, schema=None) -> DataFrame:
        """All events of whole batches."""
        done = [f"{self.path}/batches/{n}" for n in self.committed()]
        if not done:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*done)

    def follow(self, stream: DataFrame, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
        """Pushes each micro-batch of ``stream`` that has arrived. ``then`` is called with
        a batch after it is in the ledger, and again if the driver was lost before it
        ended: what it sends out must bear the batch's number, or be asked of ``events``."""

        def sink(batch: DataFrame, number: int) -> None:
            kept = batch.persist()
            try:
                self.push(kept, number)
                if then is not None:
                    then(kept, number)
            finally:
                kept.unpersist()

        return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
