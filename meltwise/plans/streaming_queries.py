"""Streaming duties with batch results to compare against."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltwise.plans.registry import query
from meltwise.sources.records import shared_folder
from meltwise.streaming import jobs

c = F.col


def event_stream(t):
    """The events table as a file stream with an event-time column for the watermark."""
    s = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return s.withColumn("event_time", c("ts").cast("timestamp"))


@query("latest_state_ttl", """
    WITH n AS (SELECT max(ts) AS now FROM f_job), l AS (SELECT key, arg_max(kind, (ts, event_id)) AS kind, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts, min(ts) AS started, count(*) AS events FROM f_job GROUP BY key),
     x AS (SELECT *, status IN ('done', 'failed') AS fin, epoch_us(now) - epoch_us(CASE WHEN status IN ('done', 'failed') THEN ts ELSE started END) AS age, CASE WHEN kind = 'design' THEN 5400 ELSE 1800 END AS lim FROM l, n)
    SELECT key, kind, CASE WHEN NOT fin AND age > lim::BIGINT * 1000000 THEN 'failed' ELSE status END AS status, events, NOT fin AND age > lim::BIGINT * 1000000 AS reaped, CASE WHEN fin THEN ts WHEN age > lim::BIGINT * 1000000 THEN now END AS finished FROM x WHERE NOT (fin AND age > 3600000000)""")
def latest_state_ttl(t):
    return jobs.latest_state(t.job)


VIOLATION_SQL = """
    SELECT date_trunc('day', ts) AS window_start, "check", count(*) AS n FROM (SELECT ts, unnest(list_filter([CASE WHEN value < 0 THEN 'negative' END, CASE WHEN value > 50 THEN 'value_high' END,
      CASE WHEN k IS NULL THEN 'props_missing' END, CASE WHEN k > 90 THEN 'k_high' END], lambda x : x IS NOT NULL)) AS "check" FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)) GROUP BY ALL"""


def arrive(t, folder: str, events) -> None:
    """Puts events into a folder as files of one arrival."""
    events.write.mode("append").parquet(folder)


@query("stream_validate", f"""
    WITH a AS (SELECT *, ts < TIMESTAMP '2024-01-20' AND event_id % 10 <> 0 AS first FROM events),
     m AS (SELECT max(ts) FILTER (first) - INTERVAL 1 DAY AS mark FROM a), e AS (SELECT a.*, NOT first AND ts < mark AS late FROM a, m)
    {VIOLATION_SQL.replace('FROM events))', 'FROM e WHERE NOT late))')}
    UNION ALL SELECT date_trunc('day', ts), 'late', count(*) FROM e WHERE late GROUP BY ALL""")
def stream_validate(t):
    """Two runs of the validation over two arrivals; the second brings new days, and rows that come too late and are counted apart."""
    folder, drop = shared_folder(t.spark, "validate"), shared_folder(t.spark, "arrivals")
    first = (c("ts") < F.lit("2024-01-20").cast("timestamp")) & (c("event_id") % 10 != 0)
    for part in (t.events.where(first), t.events.where(~first)):
        arrive(t, drop, part)
        jobs.validate_stream(jobs.stream_arrivals(t.spark, drop, t.events.schema), folder)
    _, counts, late = jobs.validated(t.spark, folder, t.events.schema)
    counts = counts.groupBy("window_start", "check").agg(F.sum("n").alias("n"))
    late = late.groupBy("window_start").agg(F.sum("n").alias("n"))
    return counts.unionByName(late.select(c("window_start").cast(counts.schema["window_start"].dataType).alias("window_start"), F.lit("late").alias("check"), "n"))


@query("batch_validate", VIOLATION_SQL)
def batch_validate(t):
    return jobs.window_counts(jobs.event_violations(t.events))


@query("stream_resume", """
    SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, count(*) FILTER (event_id % 3 <> 0) AS first_run, count(*) FILTER (event_id % 3 = 0) AS second_run FROM events GROUP BY 1""")
def stream_resume(t):
    """Two runs with one checkpoint: a part of the events twice over, then all of them, most for the second time and out of order."""
    folder, drop = shared_folder(t.spark, "resume-stream"), shared_folder(t.spark, "arrivals")
    part = t.events.where(c("event_id") % 3 != 0)
    for some in (part.unionByName(part.where(c("event_id") % 5 == 0)), t.events.orderBy(F.desc("ts"))):
        arrive(t, drop, some)
        jobs.resume_stream(jobs.stream_arrivals(t.spark, drop, t.events.schema), folder)
    rows = t.spark.read.parquet(f"{folder}/rows")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.count_if(c("batch") == 0).alias("first_run"), F.count_if(c("batch") == 1).alias("second_run"))


@query("stream_state")
def stream_state(t):
    """Status changes of the keyed state stream: updates, expiries and reaped jobs, counted."""
    s = event_stream(t)
    status = F.when(c("event_type") == "signup", "pending").when(c("event_type").isin("view", "click"), "running").when(c("event_type") == "purchase", "done").otherwise("failed")
    kind = F.when(c("user_id") % 2 == 0, "evaluate").otherwise("design")
    x = jobs.state_stream(s.select(c("user_id").alias("key"), kind.alias("kind"), status.alias("status"), c("event_time").alias("ts"), "event_id"))
    path, marks = shared_folder(t.spark, "state"), shared_folder(t.spark, "state-marks")
    sink = lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    x.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(jobs.OUTPUT + ", batch int").parquet(path).groupBy("reason", "status").agg(F.count("*").alias("n"), F.sum("events").alias("events"))
