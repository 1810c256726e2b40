"""Job status tables and record validation as batch plans and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from meltwise.operators.checkpoints import cut

c = F.col

# Seconds a finished job is kept, and how long an open one may take per kind.
FINISHED_TTL = 3600
CEILING = {"validate": 1800, "design": 5400}
DEFAULT_CEILING = 1800
TERMINAL = ["done", "failed"]


def ceiling_seconds(kind: Column) -> Column:
    out = F.lit(DEFAULT_CEILING)
    for name, seconds in CEILING.items():
        out = F.when(kind == name, seconds).otherwise(out)
    return out


def latest_state(jobs: DataFrame, now: Column | None = None) -> DataFrame:
    """Latest status per key (ties by event id); expired finished rows drop, stale open rows fail.

    ``now`` defaults to the newest event time of the whole table.
    """
    last = jobs.groupBy("key").agg(F.max_by(F.struct("kind", "status", "ts"), F.struct("ts", "event_id")).alias("s"), F.count("*").alias("events"), F.min("ts").alias("started"))
    last = last.select("key", "s.kind", "s.status", "s.ts", "events", "started")
    if now is None:
        last = last.crossJoin(F.broadcast(jobs.agg(F.max("ts").alias("_now"))))
    else:
        last = last.withColumn("_now", now)
    done = c("status").isin(*TERMINAL)
    # a finished job ages from its end, an open one from its start
    age = F.unix_micros("_now") - F.unix_micros(F.when(done, c("ts")).otherwise(c("started")))
    stale = ~done & (age > ceiling_seconds(c("kind")).cast("long") * 1000000)
    kept = last.where(~(done & (age > F.lit(FINISHED_TTL * 1000000))))
    return kept.select("key", "kind", F.when(stale, "failed").otherwise(c("status")).alias("status"), "events", stale.alias("reaped"),
                       F.when(done, c("ts")).when(stale, c("_now")).alias("finished"))


STATE = "kind string, status string, ts timestamp, events long, started timestamp"
OUTPUT = "key long, kind string, status string, events long, reason string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    """Keep the newest status of a key; on event-time timeout finished keys expire and open ones fail.

    As in ``latest_state`` a finished job ages from its end and an open one from its start.
    """
    if state.hasTimedOut:
        kind, status, _, events, _ = state.get
        state.remove()
        reason = "expired" if status in TERMINAL else "reaped"
        yield pd.DataFrame({"key": [key[0]], "kind": [kind], "status": [status if reason == "expired" else "failed"],
                            "events": [events], "reason": [reason]})
        return
    current = state.get if state.exists else None
    for pdf in batches:
        rows = pdf.sort_values(["ts", "event_id"])
        row, first = rows.iloc[-1], rows.iloc[0]["ts"].to_pydatetime()
        n = (current[3] if current else 0) + len(rows)
        started = min(first, pd.Timestamp(current[4]).to_pydatetime()) if current else first
        if current is None or row["ts"].to_pydatetime() >= pd.Timestamp(current[2]).to_pydatetime():
            current = (row["kind"], row["status"], row["ts"].to_pydatetime(), n, started)
        else:
            current = (current[0], current[1], current[2], n, started)
    if current is None:
        return
    state.update(current)
    done = current[1] in TERMINAL
    hold = FINISHED_TTL if done else CEILING.get(current[0], DEFAULT_CEILING)
    wake = int(pd.Timestamp(current[2] if done else current[4]).timestamp() * 1000) + hold * 1000
    state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"key": [key[0]], "kind": [current[0]], "status": [current[1]], "events": [current[3]], "reason": ["update"]})


def state_stream(jobs: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Stream of status changes with expiry by event-time timeouts."""
    return (
        jobs.withWatermark("ts", lateness).groupBy("key")
        .applyInPandasWithState(_advance, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout))


def event_violations(events: DataFrame) -> DataFrame:
    """Range checks of arriving events, one row per violation."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    checks = F.array_compact(F.array(
        F.when(c("value") < 0, F.lit("negative")), F.when(c("value") > 50, F.lit("value_high")),
        F.when(k.isNull(), F.lit("props_missing")), F.when(k > 90, F.lit("k_high"))))
    return events.select("event_id", "ts", "event_type", F.explode(checks).alias("check"))


def window_counts(violations: DataFrame, width: str = "1 day") -> DataFrame:
    return violations.groupBy(F.window("ts", width).alias("w"), "check").agg(F.count("*").alias("n")).select(
        c("w.start").alias("window_start"), "check", "n")


def stream_arrivals(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The files that arrive in a folder as a stream, with an event-time column."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder).withColumn("event_time", c("ts").cast("timestamp"))


def _run(stream: DataFrame, sink: Callable[[DataFrame, int], None], marks: str) -> None:
    """All that has arrived since the last run whose checkpoint ``marks`` names."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def _put(df: DataFrame, path: str, *parts: str) -> None:
    """Writes a batch's rows so that the same batch, run again, takes the place of its first attempt."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _earlier(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """What batches before this one have written; nothing before the first has."""
    found = spark.createDataFrame([], schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        found = spark.read.schema(schema).parquet(path)
    return found.where(c("batch") < batch_id)


def validate_stream(events: DataFrame, folder: str, lateness: str = "1 day") -> None:
    """Checks what has arrived; a later run with the same ``folder`` resumes where this one ended.

    Violations go to ``violations``, their counts by day to ``counts``, rows older than the newest event of earlier batches less
    ``lateness`` to ``late``, uncounted. The newest event of each batch is kept in ``seen``, so the watermark outlives the run. All tables are written by batch:
    a batch that runs again overwrites its own rows, and sums over batches are complete.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch)  # read several times below
        newest = _earlier(spark, f"{folder}/seen", "newest timestamp, batch int", batch_id).agg((F.max("newest") - F.expr(f"interval {lateness}")).alias("mark")).first()["mark"]
        late = F.lit(False) if newest is None else c("event_time") < F.lit(newest)
        tag = F.lit(batch_id).alias("batch")
        _put(batch.agg(F.max("event_time").alias("newest"), tag), f"{folder}/seen", "batch")
        _put(batch.where(late).groupBy(F.date_trunc("day", "event_time").alias("window_start")).agg(F.count("*").alias("n")).select("*", tag), f"{folder}/late", "batch")
        found = event_violations(batch.where(~late))
        _put(found.select("*", tag), f"{folder}/violations", "batch")
        _put(window_counts(found).select("*", tag), f"{folder}/counts", "batch")

    _run(events, sink, f"{folder}/marks")


def validated(spark: SparkSession, folder: str, schema: StructType) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(violations, counts, late) of all runs in a folder; ``schema`` is that of the events."""
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    day = "timestamp" if types["ts"] == "timestamp" else types["ts"]
    table = lambda name, columns: spark.read.schema(f"{columns}, batch int").parquet(f"{folder}/{name}")
    return (
        table("violations", f"event_id {types['event_id']}, ts {types['ts']}, event_type string, check string"),
        table("counts", f"window_start {day}, check string, n long"), table("late", "window_start timestamp, n long"))


def resume_stream(events: DataFrame, folder: str, key: str = "event_id") -> None:
    """Takes what has arrived and is not in the output yet; a later run with the same ``folder`` continues.

    The checkpoint remembers the files that have been read. Rows that arrive again, in whatever file and however late, are found by their
    key among the output of the days of the batch, and repeated keys inside a batch count once, so every key is written once.
    """
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("day", F.to_date("event_time"))
        known = _earlier(spark, f"{folder}/rows", f"{names}, day date, batch int", batch_id)
        days = F.broadcast(batch.select(c("day").alias("_day")).distinct())  # as many rows as days
        known = known.join(days, c("day") == c("_day"), "left_semi").select(c(key).alias("_known"), c("day").alias("_on"))
        new = batch.join(known, (c(key) == c("_known")) & (c("day") == c("_on")), "left_anti").dropDuplicates([key])
        _put(new.select("*", F.lit(batch_id).alias("batch")), f"{folder}/rows", "day", "batch")

    _run(events, sink, f"{folder}/marks")
