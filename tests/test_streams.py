import datetime as dt

import pandas as pd

from meltwise.streaming import jobs

SCHEMA = "event_id long, ts timestamp, event_type string, value double, props string"


def event(i, day, value=-1.0):
    return (i, dt.datetime(2024, 1, day, 12), "view", value, '{"k": 5}')


def arrive(spark, folder, *rows):
    spark.createDataFrame(list(rows), SCHEMA).write.mode("append").parquet(folder)


def test_a_second_run_resumes_and_counts_late_rows(spark, tmp_path):
    drop, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], SCHEMA).schema
    run = lambda: jobs.validate_stream(jobs.stream_arrivals(spark, drop, schema), out)
    late = lambda: [(r.window_start.day, r.n) for r in jobs.validated(spark, out, schema)[2].collect()]
    seen = lambda: sorted(r.event_id for r in jobs.validated(spark, out, schema)[0].collect())
    arrive(spark, drop, event(1, 10), event(2, 2), event(3, 10, 5.0))
    run()
    assert seen() == [1, 2] and late() == []  # nothing came before, so nothing is late
    run()
    assert seen() == [1, 2]  # nothing has arrived
    arrive(spark, drop, event(4, 8), event(5, 9), event(6, 3), event(7, 12), event(8, 3))
    run()
    assert seen() == [1, 2, 5, 7] and sorted(late()) == [(3, 2), (8, 1)]  # the mark is the noon of the 9th
    arrive(spark, drop, event(9, 10))
    run()
    assert seen() == [1, 2, 5, 7] and sorted(late()) == [(3, 2), (8, 1), (10, 1)]


def test_repeated_and_late_ids_are_taken_once(spark, tmp_path):
    drop, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], SCHEMA).schema
    run = lambda: jobs.resume_stream(jobs.stream_arrivals(spark, drop, schema), out)
    rows = lambda: sorted((r.event_id, r.batch) for r in spark.read.parquet(f"{out}/rows").collect())
    arrive(spark, drop, event(1, 10), event(1, 10), event(2, 20))
    run()
    arrive(spark, drop, event(2, 20), event(3, 1), event(1, 10))
    run()
    run()
    assert rows() == [(1, 0), (2, 0), (3, 1)]


class State:
    """As much of a group's state as the job table uses."""

    def __init__(self, mark):
        self.exists, self.hasTimedOut, self.get, self.mark, self.wake = False, False, None, mark, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists = False

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, at):
        self.wake = at


def test_an_open_job_ages_from_its_start(spark):
    start = pd.Timestamp("2024-01-01 10:00")
    state = State(0)
    rows = lambda minutes, status: iter([pd.DataFrame({"event_id": [minutes], "ts": [start + pd.Timedelta(minutes=minutes)], "kind": ["design"], "status": [status]})])
    list(jobs._advance((1,), rows(0, "pending"), state))
    list(jobs._advance((1,), rows(80, "running"), state))
    assert state.wake == start.timestamp() * 1000 + jobs.CEILING["design"] * 1000  # not from the later event
    list(jobs._advance((1,), rows(85, "done"), state))
    assert state.wake == (start + pd.Timedelta(minutes=85)).timestamp() * 1000 + jobs.FINISHED_TTL * 1000
    state.hasTimedOut = True
    assert [(r.status[0], r.reason[0]) for r in jobs._advance((1,), iter([]), state)] == [("done", "expired")]
