"""Job states, the serial queue and the event log, across restarts and replays."""

import random

import pytest
from pyspark.sql import functions as F

from lorebase.streaming import lifecycle
from lorebase.streaming.eventlog import EventLog

SCHEMA = "project_id string, job_id string, event_id long, status string, progress double, ts timestamp"


class Feed:
    """A folder that events arrive in."""

    def __init__(self, spark, path):
        self.spark, self.path, self.next = spark, str(path), 0

    def add(self, *events):
        rows = []
        for job, status, at, *more in events:
            self.next += 1
            rows.append((more[0] if more else "p", job, self.next, status, more[1] if len(more) > 1 else None, at))
        df = self.spark.createDataFrame(rows, SCHEMA.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)


def test_states_survive_a_restart_and_refuse_illegal_moves(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    run = lambda: lifecycle.run_once(lifecycle.lifecycle(feed.stream()), str(tmp_path / "c"), str(tmp_path / "out"))
    feed.add(("a", "running", 1), ("a", "queued", 2), ("b", "queued", 3), ("a", "running", 4, "p", 0.4))
    run()
    feed.add(("a", "running", 5, "p", 7.0), ("b", "succeeded", 6), ("b", "cancelled", 7), ("a", "running", 8, "p", 0.2), ("a", "succeeded", 9), ("a", "failed", 10))
    out = run()  # a new query from the checkpoint
    got = {(r["job_id"], r["seq_no"]): (r["wanted"], r["accepted"], r["status"], r["progress"]) for r in out.collect()}
    assert got == {
        ("a", 1): ("running", False, "", 0.0), ("a", 2): ("queued", True, "queued", 0.0), ("a", 3): ("running", True, "running", 0.4), ("a", 4): ("running", True, "running", 1.0),
        ("a", 5): ("running", True, "running", 1.0), ("a", 6): ("succeeded", True, "succeeded", 1.0), ("a", 7): ("failed", False, "succeeded", 1.0),
        ("b", 1): ("queued", True, "queued", 0.0), ("b", 2): ("succeeded", False, "queued", 0.0), ("b", 3): ("cancelled", True, "cancelled", 0.0),
    }
    assert run().count() == len(got)  # nothing new arrived


def test_a_job_that_falls_silent_has_failed(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    run = lambda: lifecycle.run_once(lifecycle.lifecycle(feed.stream(), lease_seconds=60), str(tmp_path / "c"), str(tmp_path / "out"))
    feed.add(("a", "queued", 1), ("a", "running", 2), ("b", "queued", 1), ("b", "running", 50))
    run()
    feed.add(("c", "queued", 100))
    run()
    feed.add(("c", "cancelled", 101), ("b", "succeeded", 101))
    out = run().collect()
    last = {}
    for r in sorted(out, key=lambda r: (r["job_id"], r["seq_no"])):
        last[r["job_id"]] = (r["status"], r["message"])
    assert last == {"a": ("failed", "lease expired"), "b": ("succeeded", None), "c": ("cancelled", None)}


def plain(events):
    """The queue played event by event."""
    waiting, running, seen, over, out = {}, {}, set(), set(), []
    for project, job, status in events:
        own = waiting.setdefault(project, [])
        if status == "queued" and (project, job) not in seen:
            seen.add((project, job))
            own.append(job)
        elif status in ("succeeded", "failed", "cancelled") and (project, job) in seen - over:
            over.add((project, job))
            if running.get(project) == job:
                running[project] = None
            else:
                own.remove(job)
        if running.get(project) is None and own:
            running[project] = own.pop(0)
            out.append((project, running[project]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jobs_start_in_order_whatever_is_replayed(spark, tmp_path, seed):
    r, feed, events = random.Random(seed), Feed(spark, tmp_path / "in"), []
    run = lambda: lifecycle.run_once(lifecycle.serial_queue(feed.stream()), str(tmp_path / "c"), str(tmp_path / "out"))
    at = 0
    for _ in range(3):
        batch = [(f"j{r.randrange(9)}", r.choice(["queued", "queued", "succeeded", "failed", "cancelled", "running"]), r.choice("pq")) for _ in range(60)]
        timed = []
        for job, status, project in batch:
            at += 1
            timed.append((job, status, at, project))
            events.append((project, job, status))
        feed.add(*timed)
        run()
    got = [(x["project_id"], x["turn"], x["job_id"]) for x in run().orderBy("project_id", "turn").collect()]
    want = []
    for p in "pq":
        want += [(p, k, job) for k, job in enumerate((j for q, j in plain(events) if q == p), 1)]
    assert got == want and len({(p, j) for p, _, j in got}) == len(got) > 6


def test_a_replayed_or_broken_batch_adds_nothing(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log")
    a, b = spark.range(3), spark.range(3, 5)
    assert log.events("id long").count() == 0 and log.push(a, 0) and not log.push(b, 0)
    b.write.parquet(f"file://{tmp_path}/log/batches/1")  # an attempt that was lost before the ledger
    assert sorted(r["id"] for r in log.events().collect()) == [0, 1, 2] and log.committed() == [0]
    assert log.push(b.where("id = 4"), 1)
    assert sorted(r["id"] for r in EventLog(spark, log.path).events().collect()) == [0, 1, 2, 4]


def test_following_a_stream_whose_checkpoint_is_behind(spark, tmp_path):
    feed, log, sent = Feed(spark, tmp_path / "in"), EventLog(spark, f"file://{tmp_path}/log"), []
    feed.add(("a", "queued", 1), ("a", "running", 2))
    feed.add(("b", "queued", 3))
    then = lambda batch, n: sent.append((n, batch.count()))
    log.follow(feed.stream(), str(tmp_path / "c"), then).awaitTermination()
    log.follow(feed.stream(), str(tmp_path / "lost"), then).awaitTermination()  # all batches once more
    assert log.events().count() == 3 and log.committed() == [0, 1] and sorted(sent) == [(0, 2), (0, 2), (1, 1), (1, 1)]


def test_the_queue_over_a_whole_table(spark):
    """The registered query against the queue played event by event."""
    from lorebase.plans import queries

    d = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in queries.QUERIES["job_queue"](spark, d).select("project_id", "turn", "job_id").collect())
    events = queries.job_events(queries.table(spark, d, "events")).orderBy("ts", "event_id").collect()
    turns, want = {}, []
    for p, j in plain([(r["project_id"], r["job_id"], r["status"]) for r in events]):
        turns[p] = turns.get(p, 0) + 1
        want.append((p, turns[p], j))
    assert got == sorted(want) and len(want) > 20


def test_a_queue_is_told_of_each_job_twice_at_most():
    """Replays and other events of a job end before the project's state, however many there are, batch by batch."""

    class Value:
        def __init__(self):
            self.now = None

        def exists(self):
            return self.now is not None

        def get(self):
            return self.now

        def update(self, now):
            self.now = now

    ends = lifecycle._Ends()
    ends.phase, r, got, want, phase = Value(), random.Random(6), [], [], 0
    for batch in range(4):
        rows = [{"ts": batch * 100 + k // 2, "event_id": batch * 100 + k, "status": r.choice(["succeeded", "queued", "failed"])} for k in range(batch * 30)]
        for x in rows:
            if phase < 2 and (x["status"] == "queued") == (phase == 0):
                phase += 1
                want.append((x["event_id"], x["status"]))
        got += [(x["event_id"], x["status"]) for x in ends.handleInputRows(("p", "j"), iter(r.sample(rows, len(rows))), None)]
    assert got == want and len(got) == 2
