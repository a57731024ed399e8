"""Tables in buckets of a key, of which a change reads and writes only the buckets it touches.

A table is Parquet partitioned by the hash of its key columns. Each change writes
its buckets to a folder of its own and then adds one small commit file that says
which folder holds which bucket, by a rename; readers follow the last commit. A
change that is stopped leaves the table as it was, and of two that begin at the
same commit the second fails.

A change deals out only the rows it brings and the old ones with their keys. All
others are copied, a bucket at a time, by the tasks that read them: they are neither
shuffled nor sorted.

Rows: keys may be null (one bucket) and may repeat; a table without rows can be
read and changed. A key's rows lie in one bucket, and a large bucket is written as
several files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.sources import work

#: The column that holds the bucket in the files.
BUCKET = "__bucket"
#: Tasks, and so files, that a bucket is dealt to at least.
SHARES = 2
#: Keys of a change that are sent to all tasks; with more, all rows of the buckets touched are shuffled. So they are
#: where they have so few bytes, as copying takes a job for each bucket.
FEW, SMALL = 250_000, 32 << 20
#: Buckets copied at a time.
COPIES = 8


@dataclass(frozen=True)
class BucketTable:
    """A table in ``buckets`` buckets of ``keys``, under ``folder``."""

    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    buckets: int
    schema: T.StructType

    @staticmethod
    def create(df: DataFrame, folder: str, keys: Iterable[str], buckets: int = 64, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> BucketTable:
        """Write ``then(df)`` as a new table.

        ``then`` goes row by row and leaves keys as they are; it is applied after the
        rows were dealt out, so that what it adds is not shuffled.
        """
        table = BucketTable(df.sparkSession, folder, tuple(keys), buckets, then(df).schema)
        table._commit(1, dict.fromkeys(range(buckets), table._write(df, then)))
        return table

    @staticmethod
    def open(spark: SparkSession, folder: str) -> BucketTable:
        """A table that was written before."""
        said = BucketTable(spark, folder, (), 0, T.StructType())._said()
        return BucketTable(spark, folder, tuple(said["keys"]), said["buckets"], T.StructType.fromJson(said["schema"]))

    def bucket(self) -> Column:
        """The bucket of a row whose keys have the table's types."""
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their keys in the table's types."""
        return rows.withColumns({k: F.col(f"`{k}`").cast(self.schema[k].dataType) for k in self.keys})

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows' keys: ``buckets`` numbers at most."""
        return sorted(r[0] for r in self.keyed(rows).select(self.bucket()).distinct().collect())

    def commits(self) -> int:
        """The number of the last commit."""
        return self._said()["commit"]

    def versions(self) -> dict[int, str]:
        """The folder that holds each bucket."""
        return _versions(self._said())

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows, of some buckets only."""
        return self._read(self.versions(), buckets)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows that have the keys of ``keys``, from their buckets."""
        keys = self.keyed(keys).select(*[f"`{k}`" for k in self.keys])
        return _matching(self.read(self.buckets_of(keys)), F.broadcast(keys) if keys.count() <= FEW else keys, "left_semi")

    def _read(self, versions: dict[int, str], buckets: Iterable[int] | None) -> DataFrame:
        wanted = None if buckets is None else set(buckets)
        held: dict[str, list[int]] = {}
        for b, version in versions.items():
            if wanted is None or b in wanted:
                held.setdefault(version, []).append(b)
        stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        parts = [self.spark.read.schema(stored).parquet(f"{self.folder}/{v}").where(F.col(BUCKET).isin(sorted(bs))) for v, bs in sorted(held.items())]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionAll, parts).drop(BUCKET)

    def change(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Put ``how(old, rows)`` in place of the old rows with the keys of ``rows``, and return the buckets written anew.

        ``how`` must keep rows in their buckets and leave those with other keys as they
        are, as all that goes by key does; ``old`` may hold such rows of these buckets or not.
        """
        rows = self.keyed(rows)
        said = self._said()
        touched = self.buckets_of(rows)
        if not touched:
            return touched
        old = self._read(_versions(said), touched)
        keys = work.written(rows.select(*[f"`{k}`" for k in self.keys]).distinct(), "keys") if self._large(said, touched) else None
        if keys is not None and keys.count() <= FEW:
            self._exchange(said, touched, keys, how(_matching(old, F.broadcast(keys), "left_semi"), rows))
        else:
            self._put(said, touched, self._write(how(old, rows)))
        work.discard(keys)
        return touched

    def exchange(self, buckets: Iterable[int], gone: DataFrame, come: DataFrame) -> None:
        """In some buckets, leave out the rows that agree with one of ``gone`` in its columns, and add ``come``, which must belong there."""
        said, buckets = self._said(), sorted(set(buckets))
        if self._large(said, buckets) and gone.count() <= FEW:
            self._exchange(said, buckets, gone, come)
        else:
            kept = _matching(self._read(_versions(said), buckets), gone, "left_anti")
            self._put(said, buckets, self._write(kept.unionByName(come.select(*kept.columns))))

    def _large(self, said: dict, buckets: list[int]) -> bool:
        versions = _versions(said)
        return sum(work.size(self.spark, f"{self.folder}/{versions[b]}/{BUCKET}={b}") for b in buckets) > SMALL

    def _exchange(self, said: dict, buckets: list[int], gone: DataFrame, come: DataFrame) -> None:
        version = self._write(come)

        def copy(b: int) -> None:
            kept = _matching(self._read(_versions(said), [b]), F.broadcast(gone), "left_anti")
            # as many files as before, however often it is changed
            _writer(kept.coalesce(self._tasks()[1])).parquet(f"{self.folder}/{version}/{BUCKET}={b}")

        with ThreadPoolExecutor(COPIES) as pool:
            list(pool.map(copy, buckets))
        self._put(said, buckets, version)

    def _put(self, said: dict, buckets: Iterable[int], version: str) -> None:
        self._commit(said["commit"] + 1, _versions(said) | dict.fromkeys(buckets, version))

    def vacuum(self) -> None:
        """Delete folders and commits that the last commit does not need."""
        said = self._said()
        keep = {*said["versions"].values(), f"commits/{said['commit']:08d}.json"}
        for name in [*self._names(""), *(f"commits/{n}" for n in self._names("commits"))]:
            if name not in keep and name != "commits":
                work.delete(self.spark, f"{self.folder}/{name}")

    def drop(self) -> None:
        """Delete the table."""
        work.delete(self.spark, self.folder)

    def _write(self, df: DataFrame, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> str:
        version = f"v-{uuid.uuid4().hex}"
        rows = then(self._dealt(self.keyed(df)))
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields]).withColumn(BUCKET, self.bucket())
        # rows are sorted by bucket for the write anyway; those that are alike, side by side, take less space
        order = [*self.keys, *[f.name for f in self.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in self.keys]]
        _writer(rows.sortWithinPartitions(BUCKET, *[f"`{c}`" for c in order])).partitionBy(BUCKET).parquet(f"{self.folder}/{version}")
        return version

    def _tasks(self) -> tuple[int, int]:
        """The tasks that rows are dealt to, and those that a bucket is."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return tasks, max(SHARES, tasks // self.buckets)

    def _dealt(self, df: DataFrame) -> DataFrame:
        """Rows by bucket, and within one by their hash: a bucket is written by several tasks, so that one with a frequent key is no single task's."""
        tasks, shares = self._tasks()
        share = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(shares))
        return df.repartitionById(tasks, F.pmod(self.bucket() * shares + share, F.lit(tasks)).cast("int"))

    def _names(self, folder: str) -> list[str]:
        return work.names(self.spark, f"{self.folder}/{folder}")

    def _said(self) -> dict:
        last = max(n for n in self._names("commits") if n.endswith(".json"))
        return json.loads(work.read_text(self.spark, f"{self.folder}/commits/{last}"))

    def _commit(self, number: int, versions: dict[int, str]) -> None:
        said = {"commit": number, "keys": self.keys, "buckets": self.buckets, "schema": self.schema.jsonValue(), "versions": versions}
        staged = f"{self.folder}/staged-{uuid.uuid4().hex}"
        work.write_text(self.spark, staged, json.dumps(said))
        if not work.move(self.spark, staged, f"{self.folder}/commits/{number:08d}.json"):
            work.delete(self.spark, staged)
            raise RuntimeError(f"{self.folder} was changed meanwhile; nothing was written")


def _versions(said: dict) -> dict[int, str]:
    return {int(b): v for b, v in said["versions"].items()}


def _matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` that agree (left_semi) or do not agree (left_anti) with one of ``keys`` in its columns; nulls agree."""
    agree = [F.col(f"r.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in keys.columns]
    return rows.alias("r").join(keys.alias("k"), reduce(lambda a, b: a & b, agree), how)


def _writer(rows: DataFrame) -> DataFrameWriter:
    return rows.write.mode("append").option("compression", "zstd")
