"""Jobs and their logs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses from which a job can be cancelled or retried.
CANCELLABLE, RETRYABLE = ("pending", "running"), ("failed", "cancelled")


def log_stats(logs: DataFrame) -> DataFrame:
    """(job_id, total, warnings, errors, last_ts)."""
    return logs.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("level") == "warning").alias("warnings"), F.count_if(F.col("level") == "error").alias("errors"), F.max("ts").alias("last_ts"))


def log_tail(logs: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each job, oldest first."""
    last = Window.partitionBy("job_id").orderBy(F.desc("id"))
    return logs.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= n).drop("__n").orderBy("job_id", "id")


def append_logs(logs: DataFrame, new: DataFrame, jobs: DataFrame) -> DataFrame:
    """Logs with the new rows of known jobs."""
    return logs.unionByName(new.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi").select(*logs.columns))


def with_stats(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Jobs, newest first, with their log counts."""
    return jobs.join(log_stats(logs).withColumnRenamed("job_id", "id"), "id", "left").orderBy(F.desc("created_at"), F.desc("id"))


def status_counts(jobs: DataFrame) -> DataFrame:
    """(status, n)."""
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def latest_per(jobs: DataFrame, bucket: Column) -> DataFrame:
    """The newest job of each bucket."""
    order = Window.partitionBy("bucket").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.withColumn("bucket", bucket).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def metadata_is(path: str, wanted: str) -> Column:
    """A JSON path of the metadata has this value, or is absent."""
    got = F.get_json_object("metadata", path)
    return got.isNull() | (got == wanted)


def rolling_usage(intervals: DataFrame, now: Column, window_seconds: float) -> DataFrame:
    """(seconds): how much of the window before ``now`` the intervals (start_s, end_s) cover, summed; no end means still running."""
    end = F.least(F.coalesce("end_s", now), now)
    used = F.greatest(F.lit(0.0), end - F.greatest(F.col("start_s"), now - window_seconds))
    return intervals.agg(F.coalesce(F.sum(used), F.lit(0.0)).alias("seconds"))


def can_cancel(status: Column) -> Column:
    """Whether a job can be cancelled."""
    return status.isin(*CANCELLABLE)


def can_retry(status: Column) -> Column:
    """Whether a job can be retried."""
    return status.isin(*RETRYABLE)


def fingerprint(knobs: dict, work: DataFrame | None = None) -> str:
    """SHA-256 of the settings and of the work list, independent of its order; one row reaches the driver."""
    text = json.dumps(knobs, sort_keys=True, separators=(",", ":"))
    if work is not None:
        row = F.sha2(F.to_json(F.struct(*sorted(work.columns))), 256)
        halves = [F.conv(F.substring(row, s, 15), 16, 10).cast("decimal(38,0)") for s in (1, 16)]
        total = work.agg(F.count(F.lit(1)), *[F.sum(h % F.lit(10**15)) for h in halves]).first()
        text += str(tuple(map(str, total)))
    return hashlib.sha256(text.encode()).hexdigest()


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: running ones with a checkpoint wait again, others have failed."""
    running = F.col("status") == "running"
    resumable = F.get_json_object("metadata", "$.checkpoint_version") == "1"
    status = F.when(running & F.coalesce(resumable, F.lit(False)), "pending").when(running, "failed").otherwise(F.col("status"))
    return jobs.withColumn("status", status)


#: The buckets of the pipeline's status, the job type of each, and whether jobs of other images count.
PIPELINE_BUCKETS = (
    ("catalog_sync", "catalog_sync", None),
    ("embed_catalog", "batch_embed_image", ("$.image_type", "catalog")),
    ("stack_detect", "batch_stack_detect", None),
    ("catalog_similarity", "batch_catalog_similarity", None),
    ("catalog_cache_build", "catalog_cache_build", None),
)


def pipeline_status(jobs: DataFrame, buckets: tuple = PIPELINE_BUCKETS) -> DataFrame:
    """One row a bucket: its newest job, null where there is none.

    A job belongs to a bucket by its type, and by a value in its metadata where
    the bucket names one; jobs without that value count.
    """
    bucket = None
    for name, kind, value in buckets:
        mine = F.col("type") == kind
        if value is not None:
            mine = mine & metadata_is(*value)
        bucket = F.when(mine, name) if bucket is None else bucket.when(mine, name)
    newest = latest_per(jobs.where(bucket.isNotNull()), bucket)
    every = jobs.sparkSession.createDataFrame([(b[0],) for b in buckets], "bucket string")
    return every.join(newest.select("bucket", F.col("id").alias("job_id"), "type", "status", "created_at"), "bucket", "left")


def active(jobs: DataFrame) -> DataFrame:
    """Jobs that wait or run, oldest first."""
    return jobs.where(can_cancel(F.col("status"))).orderBy("created_at", "id")
