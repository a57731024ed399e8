"""Shared pieces of the corpus operators: work tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (local tests) a
    temporary folder is set; on a cluster that folder would be each machine's own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        if option.isDefined():
            return option.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the plans above
    it exact sizes.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, if it is there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def discard(*tables: DataFrame) -> None:
    """Delete work tables made by :func:`written`."""
    for table in tables:
        path = getattr(table, "_work_path", None)
        if path:
            delete(table.sparkSession, path)


#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit for Arrow batches to ``BATCH_BYTES`` where it is higher.

    Both sides of a Python worker hold whole batches, and by default a batch may
    take 64 MB. Results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(name)
    if not found.rstrip("b").isdigit() or int(found.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int, column: int | None = None, items: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows each, and to about ``items`` elements of the lists in ``column`` where one is named.

    An Arrow batch may hold tens of megabytes; this bounds what is derived from it at a time.
    """
    for batch in batches:
        start, ends = 0, None if column is None else batch.column(column).offsets.to_numpy()
        while start < batch.num_rows:
            stop = min(batch.num_rows, start + rows)
            if ends is not None:
                stop = min(stop, max(start + 1, int(np.searchsorted(ends, ends[start] + items, side="right")) - 1))
            yield batch.slice(start, stop - start)
            start = stop


def hash_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows of ``df`` by the hash of ``key``, twice as many at most.

    The share comes from a count, so no task and no driver gathers candidates;
    the same rows are chosen however the table is split.
    """
    total = df.count()
    if total <= size:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < F.lit(int((1 << 31) * size / total))).limit(2 * size)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node.

    Alternating large-star and small-star steps: each is one aggregation and one
    join on a node, and O(log n) rounds do. Every round is written to the shared
    folder, so a lost executor costs at most one round. Nodes without an edge do
    not appear. A self edge is ignored.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current, before = written(pairs, "edges"), None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        lowest = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = written(small.union(lowest.select("u", "m")).distinct(), "edges")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(current, least, large, lowest)
        current = after
        if now == before:
            out = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._work_path = current._work_path
            return out
        before = now
