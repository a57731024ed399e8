"""Line dedup by a suffix array over line ids.

A document is the sequence of the ids (128-bit hashes) of its lines. Prefix
doubling names the suffixes by their first 1, 2, 4, ... lines: the name for 2k
lines is made of the names for k lines at a place and k lines further on, which
is one join. Only suffixes whose name occurs more than once go into the next
round, so the rounds end with the longest repeated run, and lines that occur
once are never joined. Suffixes with equal names are an interval of the suffix
array with a common prefix of at least that many lines; the interval's least
place (document, then line) is the original, and every other place in it begins
a later copy.

A run of any number of lines that is a later copy is deleted when it holds at
least ``min_chars`` characters (line ends included). Such a run is the union of
its tightest runs: those with ``min_chars`` characters that lose them with their
last line, or with their first. For a line in the run, either the tightest run
that ends with it lies inside, or it comes so early that the tightest run from
the run's first line reaches over it. What lies inside is a later copy as well,
so the tightest runs, two a line at most, decide for all lengths. One of 2^k to
2^(k+1) lines is named by the level's names at its first and its last 2^k lines.
Documents are ordered by id, then by content; null ids come last.

Rows: null text stays null; empty text is one empty line. Rows with equal id and
text count as one document and are treated alike. Further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.common import discard, small_batches, written

MIN_CHARS = 20
LAST = 2**63 - 1


def _lines(docs: DataFrame) -> DataFrame:
    """(id, key, at, a, b, n) for each line; (id, key) names the document, (a, b) the line."""
    key = F.xxhash64("doc_id", "text")
    lines = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), key.alias("key"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select("id", "key", "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.length("line").cast("long").alias("n"))


def _repeated(named: DataFrame, name: str) -> DataFrame:
    """The rows of ``named`` whose name (a, b) occurs again, with ``later``: not at the least place."""
    place = F.struct("id", "key", "at")
    names = named.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first")).where("times > 1").drop("times")
    names = written(names, "names")
    out = named.join(names, ["a", "b"]).withColumn("later", place != F.col("first")).drop("first")
    out = written(out, name)
    discard(names)
    return out


def suffix_intervals(docs: DataFrame) -> list[DataFrame]:
    """For each k, the suffixes that share their first 2^k lines with another: (id, key, at, a, b, n, later)."""
    levels = [written(_repeated(_lines(docs), "lines").dropDuplicates(["id", "key", "at"]), "level")]
    while not levels[-1].isEmpty():
        size = 2 ** (len(levels) - 1)
        near = levels[-1].select("id", "key", "at", "a", "b", "n")
        far = near.select("id", "key", (F.col("at") - size).alias("at"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
        pairs = near.join(far, ["id", "key", "at"])
        named = pairs.select("id", "key", "at", F.xxhash64("a", "a2", "b").alias("a"), F.xxhash64("b", "b2", "a2").alias("b"), (F.col("n") + F.col("n2") + 1).alias("n"))
        levels.append(_repeated(named, "level"))
    discard(levels[-1])
    return levels[:-1]


def _tightest(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, key, at, size, k) of the tightest runs of more than one line; 2^k <= size < 2^(k+1)."""

    @F.pandas_udf("struct<at: array<int>, size: array<int>>")
    def runs(lengths: pd.Series) -> pd.DataFrame:
        ats, sizes = [], []
        for n in lengths:
            edge = np.concatenate([[0], np.cumsum(np.asarray(n, dtype=np.int64) + 1)])
            # from each line to the first end with enough, and back from each end to the last start with enough
            start, end = np.arange(len(n)), np.arange(1, len(n) + 1)
            ahead = np.maximum(np.searchsorted(edge, edge[:-1] + min_chars + 1), end)
            back = np.minimum(np.searchsorted(edge, edge[1:] - min_chars - 1, side="right") - 1, start)
            whole, told = ahead <= len(n), back >= 0
            both = np.unique(np.stack([np.concatenate([start[whole], back[told]]), np.concatenate([ahead[whole], end[told]])], axis=1), axis=0)
            both = both[both[:, 1] - both[:, 0] > 1]
            ats.append(both[:, 0].astype(np.int32))
            sizes.append((both[:, 1] - both[:, 0]).astype(np.int32))
        return pd.DataFrame({"at": ats, "size": sizes})

    key = F.xxhash64("doc_id", "text")
    found = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), key.alias("key"), runs(F.transform(F.split("text", "\n"), F.length)).alias("runs"))
    every = found.select("id", "key", F.explode(F.arrays_zip("runs.at", "runs.size")).alias("run")).select("id", "key", "run.at", "run.size")
    # exact: the base-2 length of a number is its bits
    return every.withColumn("k", F.length(F.bin("size")) - 1)


def later_runs(docs: DataFrame, levels: list[DataFrame], min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, key, at, size) of the tightest runs that are later copies, by the suffix intervals ``levels``."""
    names = None
    for k, level in enumerate(levels):
        one = level.select("id", "key", "at", F.lit(k).alias("k"), "a", "b")
        names = one if names is None else names.union(one)
    far = F.expr("at + size - shiftleft(1, k)")
    begun = _tightest(docs, min_chars).join(names, ["id", "key", "k", "at"]).select("id", "key", "k", "at", "size", far.alias("far"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    both = begun.join(names.withColumnRenamed("at", "far"), ["id", "key", "k", "far"])
    named = both.select("id", "key", "at", "size", F.xxhash64("size", "a1", "a", "b1").alias("a"), F.xxhash64("size", "b1", "b", "a").alias("b"))
    # written, as it is read twice and the runs come from a Python function
    named = written(named, "runs")
    longer = _repeated(named, "longer")
    levels += [longer, named]
    longer = longer.where("later").select("id", "key", "at", "size")
    return levels[0].where(F.col("later") & (F.col("n") >= min_chars)).select("id", "key", "at", F.lit(1).alias("size")).union(longer)


def suffix_array(docs: DataFrame) -> DataFrame:
    """(rank, doc_id, at, lcp) of the repeated suffixes, ordered by the names of their first 1, 2, 4, ... lines.

    ``lcp`` is the largest power of two of lines that the suffix shares with another.
    """
    every = None
    for k, level in enumerate(suffix_intervals(docs)):
        one = level.select("id", "key", "at", F.struct(F.lit(k).alias("k"), "a", "b").alias("name"))
        every = one if every is None else every.union(one)
    if every is None:
        return docs.sparkSession.createDataFrame([], "rank long, doc_id long, at int, lcp long")
    named = every.groupBy("id", "key", "at").agg(F.sort_array(F.collect_list("name")).alias("names"))
    ordered = named.orderBy("names", "id", "key", "at")
    return ordered.select(F.monotonically_increasing_id().alias("rank"), F.nullif("id", F.lit(LAST)).alias("doc_id"), "at", F.pow(F.lit(2), F.size("names") - 1).cast("long").alias("lcp"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the later copies of line runs deleted from ``text``, and n_lines, n_removed."""
    small_batches(docs.sparkSession)
    work = suffix_intervals(docs)
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(LAST)), "__key": F.xxhash64("doc_id", "text")})
    if not work:
        runs = docs.sparkSession.createDataFrame([], "id long, key long, run struct<at int, size int>")
    else:
        runs = later_runs(docs, work, min_chars).select("id", "key", F.struct("at", "size").alias("run"))
    listed = runs.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_list("run").alias("__runs"))
    listed = written(listed, "runs")
    discard(*work)
    joined = keyed.join(listed, ["__id", "__key"], "left")

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
    def cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ats, sizes in parts:
            rows = []
            for text, at, size in zip(texts, ats, sizes, strict=True):
                if text is None:
                    rows.append((None, 0, 0))
                    continue
                lines = text.split("\n")
                if at is None or not len(at):
                    rows.append((text, len(lines), 0))
                    continue
                edge = np.zeros(len(lines) + 1, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, np.asarray(at) + np.asarray(size), -1)
                gone = np.cumsum(edge)[:-1] > 0
                rows.append(("\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), int(gone.sum())))
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"]).astype({"n_lines": "int64", "n_removed": "int64"})

    # only texts that lose lines go to Python, and once: a filter on the result is not pushed below a function that is not deterministic
    loses = F.col("__runs").isNotNull()
    done = joined.withColumn("__cut", cut.asNondeterministic()(F.when(loses, F.col("text")), F.col("__runs.at"), F.col("__runs.size")))
    text = F.when(loses, F.col("__cut.text")).otherwise(F.col("text")).alias("text")
    whole = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_lines = F.when(loses, F.col("__cut.n_lines")).otherwise(whole).alias("n_lines")
    n_removed = F.when(loses, F.col("__cut.n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return done.select(*[text if c == "text" else F.col(f"`{c}`") for c in names], n_lines, n_removed)
