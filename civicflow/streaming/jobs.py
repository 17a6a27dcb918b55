"""Structured Streaming versions of the batch operators.

A job has a folder under the shared checkpoint folder, named by its source and settings, and goes on
where its last call ended: a second call reads the new files alone. It starts anew only when a
file that it has read is gone or was rewritten. ``availableNow`` processes what is there and stops.

Event-time jobs run in two steps:

* *Routing.* Each micro-batch is compared with the watermark (the newest event time of the batches
  before it, less the allowed lateness). Rows behind it, and rows without a time, go to a side table
  (``Job.late``, one partition a batch); the others to the table of rows on time.
* *State.* The rows on time are a stream of their own, with the same lateness as watermark: window
  aggregates and first-seen keys are held in the state store, which the watermark keeps bounded. No row
  reaches it too late, so none is dropped silently.

What is read merges both: late rows are counted into the result, so it equals the batch operator
whatever the order in which files land. Sinks write a folder per batch (overwritten by a replay);
when T1 to T3 have more than ``COMPACT_AFTER`` of them they are merged into one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions.datetime import week_start
from civicflow.operators import weather
from civicflow.session import scratch_path
from civicflow.sources.tables import files_of

MEANS = {"TMAX": "tmax_avg", "TMIN": "tmin_avg", "PRCP": "prcp_avg"}
FLAGS = {"AWND_bool": "severe_wind", "severe_weather_event": "severe_weather_event"}
LATENESS = "14 days"
COMPACT_AFTER = 8
MONDAY = "4 days"  # offset of weekly windows: 1970-01-05 was a Monday


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet file stream over ``path``: a directory, or one file (read as its
    directory filtered to that file name -- file sources watch directories)."""
    reader = spark.readStream.schema(schema)
    fs, target = _hadoop(spark, path)
    if fs.exists(target) and fs.getFileStatus(target).isFile():
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


@dataclass(frozen=True)
class Job:
    """The folder of a job: what it wrote, its side table, its checkpoints."""

    spark: SparkSession
    base: str

    def path(self, part: str) -> str:
        return f"{self.base}/{part}"

    def written(self, part: str) -> DataFrame | None:
        return _written(self.spark, self.path(part))

    def late(self) -> DataFrame | None:
        """The side table: rows behind the watermark of their batch (``batch_id``); None without any."""
        return self.written("late")


def open_job(spark: SparkSession, name: str, path: str, *settings) -> Job:
    """The job of a source: resumed if all that it has read is still there, else new."""
    digest = hashlib.sha256(repr((path, settings)).encode()).hexdigest()[:16]
    job = Job(spark, scratch_path(spark, f"stream-{name}-{digest}"))
    now = files_of(spark, path)
    before = job.written("source")
    if before is not None and not {tuple(r) for r in before.collect()} <= set(now):  # a row a file
        fs, target = _hadoop(spark, job.base)
        fs.delete(target, True)
    spark.createDataFrame(now, "path string, length long, modified long").coalesce(1).write.mode("overwrite").parquet(job.path("source"))
    return job


def run_available_now(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                      sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Drive ``stream`` over everything available. The default sink writes each micro-batch to
    ``out/batch_id=N`` (overwrite, so a retried batch replaces itself)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink or write)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def _written(spark: SparkSession, out: str) -> DataFrame | None:
    """What a job wrote, None if it wrote no batch; every other read error is raised."""
    try:
        return spark.read.parquet(out)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_v"))
    return latest.select(*keys, "_v.*")


def read_latest(spark: SparkSession, out: str, keys: list[str], schema: str) -> DataFrame:
    """Final table of an update-mode job: the newest version of each key."""
    df = _written(spark, out)
    return spark.createDataFrame([], schema) if df is None else _latest(df, keys)


def compact(job: Job, part: str, merge: Callable[[DataFrame], DataFrame], after: int = COMPACT_AFTER) -> None:
    """Merge the batches of a sink into the newest one's folder when there are more than ``after``.

    ``merge`` gives the rows that a reader would make of the batches. They are written aside, moved
    into the newest batch's folder (whose own rows say the same) and only then are the older
    batches deleted, so a job that ends in between leaves a table with the same result."""
    fs, folder = _hadoop(job.spark, job.path(part))
    if not fs.exists(folder):
        return
    batches = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(folder) if f.getPath().getName().startswith("batch_id="))
    if len(batches) <= after:
        return
    path = job.spark._jvm.org.apache.hadoop.fs.Path
    aside = job.path(f"merged-{part}")
    merge(job.written(part)).write.mode("overwrite").parquet(aside)
    for f in fs.listStatus(path(aside)):
        if f.getPath().getName().endswith(".parquet"):
            fs.rename(f.getPath(), path(job.path(f"{part}/batch_id={batches[-1]}/{f.getPath().getName()}")))
    for b in batches[:-1]:
        fs.delete(path(job.path(f"{part}/batch_id={b}")), True)


def route(job: Job, stream: DataFrame, lateness: str) -> None:
    """Step 1: split ``stream`` (with a column ``event_time``) into rows on time and late ones."""
    spark = job.spark

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        seen = job.written("watermark")  # a row a batch
        mark = None if seen is None else seen.where(F.col("batch_id") < batch_id).agg(
            F.max("newest") - F.expr(f"interval {lateness}")).first()[0]
        behind = F.col("event_time").isNull() if mark is None else F.col("event_time").isNull() | (F.col("event_time") < F.lit(mark))
        batch.where(~behind).write.mode("overwrite").parquet(job.path(f"on_time/batch_id={batch_id}"))
        late = batch.where(behind)
        if not late.isEmpty():
            late.write.mode("overwrite").parquet(job.path(f"late/batch_id={batch_id}"))
        newest = batch.agg(F.max("event_time").alias("newest"))
        newest.coalesce(1).write.mode("overwrite").parquet(job.path(f"watermark/batch_id={batch_id}"))
        batch.unpersist()

    run_available_now(stream, "", job.path("route-checkpoint"), sink=sink)


def on_time(job: Job, schema: str, lateness: str) -> DataFrame | None:
    """Step 2's source: the rows on time as a stream with the watermark; None before the first row."""
    if job.written("on_time") is None:
        return None
    rows = job.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(job.path("on_time"))
    return rows.withWatermark("event_time", lateness)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def weekly_counts_stream(spark: SparkSession, path: str, schema: str, ts: str, key: str, lateness: str = LATENESS,
                         job: Job | None = None) -> DataFrame:
    """Weekly counts per key over Monday windows; the counts of all rows, late ones included."""
    job = job or open_job(spark, "weekly", path, schema, ts, key, lateness)
    rows = file_stream(spark, path, schema).select(F.col(ts).cast("timestamp").alias("event_time"), F.col(key).alias("key"))
    route(job, rows, lateness)
    stream = on_time(job, _ddl(rows), lateness)
    if stream is not None:
        counts = stream.groupBy(F.window("event_time", "7 days", startTime=MONDAY), "key").agg(F.count("*").alias("n"))
        counts = counts.select(F.to_date("window.start").alias("week_start"), "key", "n")
        run_available_now(counts, job.path("out"), job.path("state-checkpoint"), mode="update")
        compact(job, "out", lambda df: _latest(df, ["week_start", "key"]))
    counted = read_latest(spark, job.path("out"), ["week_start", "key"], "week_start date, key string, n long")
    late = job.late()
    if late is None:
        return counted
    both = counted.unionByName(batch_weekly_counts(late, "event_time", "key"))
    return both.groupBy("week_start", "key").agg(F.sum("n").alias("n"))


def _day_sums(rows: DataFrame, *by) -> DataFrame:
    return rows.groupBy(*by).agg(
        *[f(c).alias(f"{c}_{name}") for c in MEANS for f, name in ((F.sum, "sum"), (F.count, "n"))],
        *[F.max(c).alias(c) for c in FLAGS])


def daily_station_stream(spark: SparkSession, path: str, schema: str, to_station_day: Callable[[DataFrame], DataFrame],
                         lateness: str = LATENESS, job: Job | None = None) -> DataFrame:
    """The daily weather aggregate (G1): sums, counts and flags per day, late rows included."""
    job = job or open_job(spark, "daily", path, schema, lateness)
    days = weather.station_day_flags(to_station_day(file_stream(spark, path, schema))).filter(F.col("DATE").isNotNull())
    rows = days.select(F.col("DATE").cast("timestamp").alias("event_time"), *MEANS, *FLAGS)
    route(job, rows, lateness)
    stream = on_time(job, _ddl(rows), lateness)
    if stream is not None:
        sums = _day_sums(stream, F.window("event_time", "1 day"))
        run_available_now(sums.withColumn("DATE", F.to_date("window.start")).drop("window"), job.path("out"), job.path("state-checkpoint"), mode="update")
        compact(job, "out", lambda df: _latest(df, ["DATE"]))
    df, late = job.written("out"), job.late()
    if df is None and late is None:
        return spark.createDataFrame(
            [], "DATE date, tmax_avg double, tmin_avg double, prcp_avg double, severe_wind int, severe_weather_event int")
    parts = [] if df is None else [_latest(df, ["DATE"])]
    parts += [] if late is None else [_day_sums(late, F.to_date("event_time").alias("DATE"))]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("DATE").agg(
        *[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(a) for c, a in MEANS.items()],
        *[F.max(c).alias(a) for c, a in FLAGS.items()])


def dedupe_stream(spark: SparkSession, path: str, schema: str, key: str, ts: str, lateness: str = LATENESS,
                  job: Job | None = None) -> DataFrame:
    """Re-sent records dropped (one row per key). The state store drops those that come within
    the lateness of the first; keys that come again later, or late, are dropped at read."""
    job = job or open_job(spark, "dedupe", path, schema, key, ts, lateness)
    rows = file_stream(spark, path, schema).select(F.col(ts).cast("timestamp").alias("event_time"), key)
    route(job, rows, lateness)
    stream = on_time(job, _ddl(rows), lateness)
    if stream is not None:
        run_available_now(stream.dropDuplicatesWithinWatermark([key]).select(key), job.path("out"), job.path("state-checkpoint"))
        compact(job, "out", lambda df: df.select(key).distinct())
    parts = [df.select(key) for df in (job.written("out"), job.late()) if df is not None]
    if not parts:
        return spark.createDataFrame([], f"{key} long")
    return (parts[0] if len(parts) == 1 else parts[0].union(parts[1])).distinct()


def scoring_stream(spark: SparkSession, path: str, schema: str, score: Callable[[DataFrame], DataFrame],
                   out_schema: str, job: Job) -> DataFrame:
    """T4: each micro-batch of new texts is scored with a fitted model. ``job`` is the caller's: a
    model has to be part of its settings."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(job.path(f"out/batch_id={batch_id}"))

    run_available_now(file_stream(spark, path, schema), "", job.path("state-checkpoint"), sink=sink)
    df = job.written("out")
    return spark.createDataFrame([], out_schema) if df is None else df.drop("batch_id")


def batch_weekly_counts(df: DataFrame, ts: str, key: str) -> DataFrame:
    """Weekly counts of a table, or of T1's late rows: date_trunc('week') counts."""
    return df.groupBy(week_start(F.col(ts)).alias("week_start"), F.col(key).alias("key")).agg(
        F.count(F.lit(1)).cast("long").alias("n")
    )
