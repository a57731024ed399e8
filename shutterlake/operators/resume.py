"""Work that goes on where it was stopped, if nothing that it rests on has changed.

A work list is dealt into buckets by its key, and each bucket's result is put in
place by one rename, which is its entry in the log: a bucket is there whole or
not at all. The log lies under the fingerprint of knobs and work list, so with
other knobs, or another list, everything starts anew and the old log goes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators.jobs import fingerprint
from shutterlake.sources import work

#: Buckets of a work list.
BUCKETS = 16


def done(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The buckets that are in the log of a fingerprint."""
    return sorted(int(n.partition("=")[2]) for n in work.names(spark, f"{folder}/{name}/out") if n.startswith("bucket="))


def in_buckets(todo: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str, knobs: dict, key: str = "key", buckets: int = BUCKETS, most: int | None = None) -> DataFrame | None:
    """``step`` of the work list ``todo``, bucket after bucket; ``step`` must treat each row by itself, or rows by ``key``.

    With ``most``, at most so many buckets are worked on, and None is returned
    while some are left. Keys may be null and repeat. An empty list gives no rows.
    """
    spark = todo.sparkSession
    name = fingerprint({**knobs, "buckets": buckets}, todo)
    for other in work.names(spark, folder):
        if other != name:
            work.delete(spark, f"{folder}/{other}")
    base = f"{folder}/{name}"
    if not work.exists(spark, f"{base}/todo"):
        staged = work.new_path(spark, "todo")
        todo.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("__b").write.partitionBy("__b").parquet(staged)
        work.move(spark, staged, f"{base}/todo")
    listed = spark.read.schema(todo.withColumn("__b", F.lit(0)).schema).parquet(f"{base}/todo")
    ready = set(done(spark, folder, name))
    left = [b for b in range(buckets) if b not in ready]
    for b in left if most is None else left[:most]:
        staged = work.new_path(spark, "bucket")
        step(listed.where(F.col("__b") == b).drop("__b")).write.parquet(staged)
        if not work.move(spark, staged, f"{base}/out/bucket={b}"):  # done by another run meanwhile
            work.delete(spark, staged)
    if most is not None and len(left) > most:
        return None
    return spark.read.schema(step(todo.limit(0)).schema).parquet(*[f"{base}/out/bucket={b}" for b in range(buckets)])


def composite(stages: list[tuple], tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Run stages (name, function, and knobs if any) in order; each takes the tables and returns new ones, which are written under ``folder`` and read again.

    A stage that is done is not run again while its knobs and the tables it is
    given are the same: files are told by path, size and time, other tables by
    their rows. Otherwise it runs, and so do those after it.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, stage, *knobs in stages:
        prints = {t: work.fingerprint(df) or fingerprint({}, df) for t, df in sorted(tables.items())}
        mark = hashlib.sha256(json.dumps([name, knobs, prints], sort_keys=True).encode()).hexdigest()
        out = f"{folder}/{name}"
        if work.names(spark, f"{out}/done") != [mark]:
            work.delete(spark, out)
            made = stage(tables, **(knobs[0] if knobs else {}))
            for table, df in made.items():
                df.write.parquet(f"{out}/tables/{table}")
            work.write_text(spark, f"{out}/done/{mark}", name)
        tables = tables | {t: spark.read.parquet(f"{out}/tables/{t}") for t in work.names(spark, f"{out}/tables")}
    return tables
