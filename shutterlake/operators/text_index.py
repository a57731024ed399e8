"""An index for full-text search: postings in buckets of the stem.

Texts are split into words in the JVM and folded and stemmed in the task that reads
them, which remembers words; only postings are shuffled. A posting is a (stem, key); each stem has the count of
its texts. A search looks up the counts of its stems, reads only the buckets
that hold them (partition filters in the plan), and intersects from the rarest
stem on, so the most frequent word is a filter on few keys.

Changes go by the stems that a text had and has: only the buckets of stems that
came or went are written anew (see :mod:`shutterlake.sources.buckets`).

Rows: a null text and one without a word have no posting. Keys should be distinct
and not null. A stem that half of all texts hold makes one large bucket, which is
several files; no task holds a whole stem.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.functions.udfs import fold, porter_stem, words_in
from shutterlake.sources import work
from shutterlake.sources.buckets import BucketTable

#: Buckets of postings.
BUCKETS = 32
#: Texts taken at a time, words whose stems a task remembers (some 40 MB), and postings handed on at a time.
ROWS, KNOWN, WRITTEN = 512, 200_000, 1 << 17
#: Postings that are put together for the shuffle.
PACKED = 1 << 20
#: What surely stands between words, before folding.
BETWEEN = r"[^\p{L}\p{N}\p{M}]+"


def _stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, key), each once a row, of rows (key, words)."""
    known: dict[str, list[str]] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            lists = batch.column(1)
            words = lists.flatten().dictionary_encode()
            if len(known) > KNOWN:
                known = {}
            found = []
            for word in words.dictionary.to_pylist():
                if word not in known:
                    known[word] = sorted({porter_stem(x) for x in words_in(fold(word))})
                found.append(known[word])
            stems = pa.array([s for some in found for s in some], pa.string()).dictionary_encode()
            # a word may have several stems or none, and words of one text the same
            counts = np.array([len(some) for some in found], dtype=np.int64)
            first = np.cumsum(counts) - counts
            word = words.indices.to_numpy(zero_copy_only=False)
            times = counts[word]
            row = np.repeat(np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy())), times)
            place = np.repeat(first[word] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            pairs = np.unique(row * (len(stems.dictionary) + 1) + stems.indices.to_numpy(zero_copy_only=False)[place])
            row, stem = np.divmod(pairs, len(stems.dictionary) + 1)
            for a in range(0, len(row), WRITTEN):
                yield pa.RecordBatch.from_arrays([stems.dictionary.take(pa.array(stem[a : a + WRITTEN])), batch.column(0).take(pa.array(row[a : a + WRITTEN]))], names=["stem", "key"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, keys) of rows (stem, key): a stem once for each :data:`PACKED` postings or so, since they are shuffled."""

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        stems = whole.column("stem").combine_chunks().dictionary_encode(null_encoding="encode")
        index = stems.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.bincount(index, minlength=len(stems.dictionary)))
        keys = whole.column("key").combine_chunks().take(pa.array(np.argsort(index, kind="stable")))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), keys)
        yield pa.RecordBatch.from_arrays([stems.dictionary, lists], names=["stem", "keys"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED:
            yield from one(held)
            held, n = [], 0
    if n:
        yield from one(held)


def postings(texts: DataFrame) -> DataFrame:
    """Distinct (stem, key) of (key, text).

    A text's words are stemmed in the task that reads it, and each word once for
    as long as the task remembers it, so nothing is shuffled but the postings.
    """
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.where("text is not null").select("key", "text")
    if rows.rdd.getNumPartitions() < texts.sparkSession.sparkContext.defaultParallelism:  # a few files: not all would have anything to do
        rows = rows.repartition(tasks)
    words = rows.select("key", F.array_distinct(F.split("text", BETWEEN)).alias("words"))
    found = words.mapInArrow(_stemmed, T.StructType([T.StructField("stem", T.StringType()), rows.schema["key"]]))
    return _once(found, texts)


def _once(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``found`` without repeated (stem, key), which only keys that repeat in ``rows`` can have; so it is shuffled only if some do."""
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found if several.isEmpty() else found.distinct()


@dataclass(frozen=True)
class TextIndex:
    """Postings (stem, key) and counts (stem, n)."""

    postings: BucketTable
    counts: BucketTable

    def search(self, stems: list[str]) -> DataFrame:
        """(key) of the texts that hold every stem."""
        spark, stems = self.postings.spark, sorted(set(stems))
        wanted = spark.createDataFrame([(s,) for s in stems], "stem string")
        place = {r["stem"]: r["b"] for r in wanted.select("stem", self.postings.bucket().alias("b")).collect()}
        found = self.counts.read({place[s] for s in stems}).where(F.col("stem").isin(stems))
        n = {r["stem"]: r["n"] for r in found.collect()}  # a row for each word of the search
        if not stems or any(n.get(s, 0) == 0 for s in stems):
            return spark.createDataFrame([], T.StructType([self.postings.schema["key"]]))
        keys = [self.postings.read([place[s]]).where(F.col("stem") == s).select("key") for s in sorted(stems, key=lambda s: (n[s], s))]
        return reduce(lambda few, more: few.join(more, "key", "left_semi"), keys)

    def upsert(self, before: DataFrame, after: DataFrame) -> list[int]:
        """Take in texts that changed, given by their stems (key, tokens) before and after; returns the buckets written.

        A text that was not there before has no row in ``before``; one that was
        deleted has none in ``after``.
        """
        had, has = (df.where("tokens is not null").select(F.explode("tokens").alias("stem"), "key", F.lit(sign).alias("sign")) for df, sign in ((before, -1), (after, 1)))
        pairs = had.unionByName(has).groupBy("stem", "key").agg(F.when(F.min("sign") == F.max("sign"), F.min("sign")).otherwise(0).alias("sign"))
        told = work.written(pairs, "changes")  # a stem that stayed has sign 0
        changes = told.where("sign <> 0")
        keys = work.written(told.select("key").distinct(), "keys")

        def counted(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.unionByName(new.groupBy("stem").agg(F.sum("sign").alias("n"))).groupBy("stem").agg(F.sum("n").alias("n")).where("n > 0")

        touched = self.postings.buckets_of(changes)
        if touched:
            # by key, as the pairs are too many to be sent to every task; so stems that stayed go and come, too
            come = self.postings.keyed(told.where("sign >= 0").select("stem", "key")).where(self.postings.bucket().isin(touched))
            self.postings.exchange(touched, self._keyed(keys), come)
            self.counts.change(changes, counted)
        work.discard(told, keys)
        return touched

    def _keyed(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.col("key").cast(self.postings.schema["key"].dataType))


def build(texts: DataFrame, folder: str | None = None, buckets: int = BUCKETS) -> TextIndex:
    """The index of (key, text), written to ``folder``."""
    return _stored(postings(texts), folder, buckets)


def build_from_tokens(rows: DataFrame, folder: str | None = None, buckets: int = BUCKETS) -> TextIndex:
    """The index of (key, tokens), the stems that are kept beside descriptions; no text is read."""
    return _stored(stored_postings(rows), folder, buckets)


def stored_postings(rows: DataFrame) -> DataFrame:
    """Distinct (stem, key) of (key, tokens)."""
    return _once(rows.where("tokens is not null").select(F.explode(F.array_distinct("tokens")).alias("stem"), "key"), rows)


def _stored(found: DataFrame, folder: str | None, buckets: int) -> TextIndex:
    folder = folder or work.new_path(found.sparkSession, "text-index")
    kind = found.schema["key"].dataType.simpleString()
    packed = found.mapInArrow(_packed, f"stem string, keys array<{kind}>")
    table = BucketTable.create(packed, f"{folder}/postings", ["stem"], buckets, lambda rows: rows.select("stem", F.explode("keys").alias("key")))
    counts = table.read().groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    return TextIndex(table, BucketTable.create(counts, f"{folder}/counts", ["stem"], buckets))


def opened(spark: SparkSession, folder: str) -> TextIndex:
    """An index that was written before."""
    return TextIndex(*(BucketTable.open(spark, f"{folder}/{name}") for name in ("postings", "counts")))


def index_of(texts: DataFrame) -> TextIndex:
    """The index of a table, built once for its files as they are and kept in the shared folder; built anew for what reads no files."""
    spark = texts.sparkSession
    name = work.fingerprint(texts, BUCKETS, BETWEEN)
    if name is None:
        return build(texts)
    folder = f"{work.shared_dir(spark)}/text-index-{name}"
    if not work.exists(spark, folder):
        made = work.new_path(spark, "text-index")
        build(texts, made)
        if not work.move(spark, made, folder):  # another session was quicker
            work.delete(spark, made)
    return opened(spark, folder)
