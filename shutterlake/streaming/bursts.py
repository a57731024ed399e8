"""Bursts and job logs as streams: extensions of the incremental jobs."""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shutterlake.sources import work


#: Buckets of groups that share a call and a state, and the kinds of groups that do (the state names them in JSON).
BUCKETS, PLAIN_KINDS = 4096, {"string", "tinyint", "smallint", "int", "bigint"}


def burst_sessions(rows: DataFrame, ts: str, group: str, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """(group, start_ts, end_ts, members): sessions of each group, closed once the watermark has passed them; a gap of exactly ``gap`` merges."""
    session = F.session_window(ts, gap)
    counted = rows.withWatermark(ts, late).groupBy(group, session).agg(F.count(F.lit(1)).alias("members"), F.max(ts).alias("end_ts"))
    return counted.select(group, F.col("session_window.start").alias("start_ts"), "end_ts", "members")


def log_counts(logs: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(job_id, level, start, n): log rows in fixed windows."""
    counted = logs.withWatermark("ts", late).groupBy("job_id", "level", F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("job_id", "level", F.col("window.start").alias("start"), "n")


def follow(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream of their rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Call ``handle`` with each micro-batch; a restart resumes from the checkpoint."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def merged(segments: list[list], at: int, key: object, score: float, gap: int) -> list[list]:
    """``segments`` with a row more: [start, start key, end, best, members], by start and apart by more than ``gap``.

    ``best`` is [score, time, key] of the representative, ``members`` are (time,
    key). The row joins the segments that it is within ``gap`` of, which makes one
    of them; they are those just before and after its place.
    """
    i = bisect.bisect_right(segments, [at], key=lambda s: [s[0]])
    low = i - 1 if i and at - segments[i - 1][2] <= gap else i
    high = i + 1 if i < len(segments) and segments[i][0] - at <= gap else i
    joined = segments[low:high]
    members = [m for s in joined for m in s[4]]
    bisect.insort(members, [at, key])
    best = max([s[3] for s in joined] + [[score, at, key]])
    return [*segments[:low], [*members[0], max([s[2] for s in joined] + [at]), best, members], *segments[high:]]


def burst_stream(rows: DataFrame, ts: str, key: str, group: str, score: str, delta_ms: int, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Changes of each group's bursts, with members and representative, as rows come in, late ones included.

    A row of (group, start_us, start_key, end_us, members, representative, alive,
    version) says what a burst is now, or (alive false) that it became part of one
    that begins earlier; :func:`standing` keeps the last word on each. A gap of
    exactly ``delta_ms`` merges. Rows may come ``late`` behind the newest, in any
    order; a burst that no row can reach any more leaves the state. State is the
    open bursts of a bucket of groups with their members, deflated: a call costs
    milliseconds however few its rows are, so groups share at most ``buckets`` of
    them. A checkpoint goes on with the number that it began with. Groups of other
    than ``PLAIN_KINDS`` have a call each. The representative is the member of the
    highest score, then time, then key; a null score is the lowest. Rows without a
    time drop out; a repeated row counts again.
    """
    gap = delta_ms * 1000
    kinds = dict(rows.dtypes)
    taken = rows.where(F.col(ts).isNotNull()).select(F.col(group).alias("group"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(key).alias("key"), F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("score"))
    columns = ["group", "start_us", "start_key", "end_us", "members", "representative", "alive", "version"]
    shared = kinds[group] in PLAIN_KINDS
    if shared:
        taken = taken.withColumn("bucket", F.coalesce(F.when(F.col("group").isNotNull(), F.pmod(F.xxhash64("group"), F.lit(buckets))), F.lit(-1)))

    def handle(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, version = json.loads(zlib.decompress(state.get[0])) if state.exists else ([], 0)
        # where a call has one group, the key or the bucket of null tells it
        several, single = shared and name[0] >= 0, None if shared else name[0]
        bursts = dict(held)
        if not state.hasTimedOut:
            touched = {}
            for frame in frames:
                names = frame["group"].tolist() if several else [None] * len(frame)
                for g, at, k, x in zip(names, frame["at"].tolist(), frame["key"].tolist(), frame["score"].tolist(), strict=True):
                    segments = bursts.get(g, [])
                    touched.setdefault(g, segments)
                    bursts[g] = merged(segments, at, k, x, gap)
            version += 1
            out = []
            for g, old in touched.items():
                shown, before, now = g if several else single, {(s[0], s[1]): s for s in old}, {(s[0], s[1]): s for s in bursts[g]}
                out += [(shown, *s[:3], [k for _, k in s[4]], s[3][2], True, version) for i, s in now.items() if before.get(i) is not s]
                out += [(shown, *s[:3], [], s[3][2], False, version) for i, s in before.items() if i not in now]
            if out:
                yield pd.DataFrame(out, columns=columns)
        mark = state.getCurrentWatermarkMs()
        # a row to come is not older than the mark
        left = [[g, kept] for g, segments in bursts.items() if (kept := [s for s in segments if s[2] + gap >= mark * 1000])]
        if left:
            state.update((zlib.compress(json.dumps([left, version]).encode(), 1),))
            state.setTimeoutTimestamp(max(mark + 1, min(s[2] for _, segments in left for s in segments) // 1000 + delta_ms + 1))
        elif state.exists:
            state.remove()

    kind = kinds[key]
    schema = f"group {kinds[group]}, start_us long, start_key {kind}, end_us long, members array<{kind}>, representative {kind}, alive boolean, version long"
    return taken.withWatermark("ts", late).groupBy("bucket" if shared else "group").applyInPandasWithState(handle, schema, "data binary", "update", GroupStateTimeout.EventTimeTimeout)


def standing(changes: DataFrame) -> DataFrame:
    """(group, start_us, start_key, end_us, members, representative) of the bursts that stand after all changes."""
    last = changes.groupBy("group", "start_us", "start_key").agg(F.max_by(F.struct("end_us", "members", "representative", "alive"), "version").alias("last"))
    return last.where("last.alive").select("group", "start_us", "start_key", "last.end_us", "last.members", "last.representative")


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there, into ``folder``, and return all it put out; a second run goes on from the checkpoint."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    each = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint")
    each.trigger(availableNow=True).start().awaitTermination()
    spark, batches = stream.sparkSession, work.names(stream.sparkSession, f"{folder}/out")
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/out/{b}" for b in batches]) if batches else spark.createDataFrame([], stream.schema)
