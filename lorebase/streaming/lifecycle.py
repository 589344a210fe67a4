"""Jobs as keyed state machines: their lifecycle and the serial queue of each project.

Both read a stream of events and keep their state in Spark's state store, which a
restarted query takes up where its checkpoint left it. Events of one key and batch
are taken in the order of (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# A job's states, and the moves between them.
QUEUED, RUNNING, SUCCEEDED, FAILED, CANCELLED = "queued", "running", "succeeded", "failed", "cancelled"
MOVES = {"": (QUEUED,), QUEUED: (RUNNING, CANCELLED), RUNNING: (RUNNING, SUCCEEDED, FAILED, CANCELLED), SUCCEEDED: (), FAILED: (), CANCELLED: ()}

STATES = "job_id {0}, seq_no long, ts timestamp, status string, wanted string, accepted boolean, progress double, message string"
TURNS = "project_id {0}, turn long, job_id {1}, ts timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Jobs(StatefulProcessor):
    """STR-02: a row for each event: whether its move was allowed, and the job's state since."""

    def __init__(self, lease_seconds: int | None):
        self.lease = lease_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, seq_no long, progress double, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, seq, progress, until = self.job.get() if self.job.exists() else ("", 0, 0.0, None)
        before = until
        for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
            seq += 1
            ok = r["status"] in MOVES[status]
            if ok:
                status = r["status"]
                if status == RUNNING and r["progress"] is not None:
                    progress = min(1.0, max(progress, r["progress"]))
                progress = 1.0 if status == SUCCEEDED else progress
                until = int(r["ts"].timestamp() * 1000) + self.lease * 1000 if self.lease and status == RUNNING else None
            yield Row(job_id=key[0], seq_no=seq, ts=r["ts"], status=status, wanted=r["status"], accepted=ok, progress=progress, message=r["message"])
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if until is not None:
                self.handle.registerTimer(until)
        self.job.update((status, seq, progress, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, seq, progress, until = self.job.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if status == RUNNING and until == at:
            import datetime

            self.job.update((FAILED, seq + 1, progress, None))
            ts = datetime.datetime.fromtimestamp(at / 1000)
            yield Row(job_id=key[0], seq_no=seq + 1, ts=ts, status=FAILED, wanted=FAILED, accepted=True, progress=progress, message="lease expired")

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, lease_seconds: int | None = None, late: str = "0 seconds") -> DataFrame:
    """STR-02/03: what becomes of each of ``events`` (job_id, ts, event_id, status and,
    if there, progress and message), a stream: job_id, seq_no, ts, status (the job's
    since then), wanted, accepted, progress and message.

    A job is queued, running, then succeeded, failed or cancelled; other moves are
    refused and change nothing. Progress lies within [0, 1] and never falls. With
    ``lease_seconds``, a job that runs so long without an event has failed; time is
    that of the events, which may come ``late``.
    """
    spark, kind = events.sparkSession, dict(events.dtypes)["job_id"]
    spark.conf.set(PROVIDER, ROCKS)
    for name, t in (("progress", "double"), ("message", "string")):
        if name not in events.columns:
            events = events.selectExpr("*", f"CAST(NULL AS {t}) AS {name}")
    events = events.select("job_id", "ts", "event_id", "status", "progress", "message")
    if lease_seconds:
        events = events.withWatermark("ts", late)
    return events.groupBy("job_id").transformWithState(_Jobs(lease_seconds), STATES.format(kind), "append", "EventTime" if lease_seconds else "None")


class _Ends(StatefulProcessor):
    """Of a job's events those that a queue heeds: the first that queues it and the first that ends it since."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.phase = handle.getValueState("phase", "phase int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        phase = self.phase.get()[0] if self.phase.exists() else 0
        if phase < 2:
            for ts, event, status in sorted((r["ts"], r["event_id"], r["status"]) for r in rows):
                if phase < 2 and (status == QUEUED) == (phase == 0):
                    phase += 1
                    yield Row(project_id=key[0], job_id=key[1], ts=ts, event_id=event, status=status)
            self.phase.update((phase,))

    def close(self) -> None:
        pass


class _Turns(StatefulProcessor):
    """STR-01: hands out a project's jobs one after another. Those that wait are kept by
    their place, from ``head`` to before ``tail``, so that a batch reads just those it starts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", f"turn long, running {self.kind}, head long, tail long")
        self.waiting = handle.getMapState("waiting", "place long", f"job_id {self.kind}")
        self.known = handle.getMapState("known", f"job_id {self.kind}", "place long")

    def __init__(self, kind: str):
        self.kind = kind

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        turn, running, head, tail = self.state.get() if self.state.exists() else (0, None, 0, 0)
        for ts, _, job, status in sorted((r["ts"], r["event_id"], r["job_id"], r["status"]) for r in rows):
            if status == QUEUED:
                self.known.updateValue((job,), (tail,))
                self.waiting.updateValue((tail,), (job,))
                tail += 1
            elif running == job:
                running = None
            else:
                self.waiting.removeKey(self.known.getValue((job,)))
            while running is None and head < tail:
                if self.waiting.containsKey((head,)):
                    running, turn = self.waiting.getValue((head,))[0], turn + 1
                    self.waiting.removeKey((head,))
                    yield Row(project_id=key[0], turn=turn, job_id=running, ts=ts)
                head += 1
        self.state.update((turn, running, head, tail))

    def close(self) -> None:
        pass


def serial_queue(events: DataFrame) -> DataFrame:
    """STR-01: (project_id, turn, job_id, ts) for each job that ``events`` (project_id,
    job_id, ts, event_id, status) let start: the first that waits, once the one before
    it in its project has succeeded, failed or been cancelled. Jobs start in the order
    in which they were queued, each once, whatever is replayed; a waiting job that is
    cancelled never starts. A task holds a batch's events of one job, and of a project
    two of each job."""
    spark, kinds = events.sparkSession, dict(events.dtypes)
    spark.conf.set(PROVIDER, ROCKS)
    events = events.select("project_id", "job_id", "ts", "event_id", "status").where(F.col("status").isin(QUEUED, SUCCEEDED, FAILED, CANCELLED))
    ends = "project_id {project_id}, job_id {job_id}, ts {ts}, event_id {event_id}, status string".format(**kinds)
    events = events.groupBy("project_id", "job_id").transformWithState(_Ends(), ends, "append", "None")
    return events.groupBy("project_id").transformWithState(_Turns(kinds["job_id"]), TURNS.format(kinds["project_id"], kinds["job_id"]), "append", "None")


def run_once(stream: DataFrame, checkpoint: str, table: str) -> DataFrame:
    """What has arrived for ``stream`` goes to the Parquet table, each result once
    (the sink logs its batches); returns the table."""
    spark: SparkSession = stream.sparkSession
    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(table).awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)
