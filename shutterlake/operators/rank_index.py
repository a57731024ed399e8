"""Deep pages: rows in ranges of their order, with a count of each range.

A page reads only the ranges that hold it, whatever its offset, and the total is
the sum of the counts. Ranges are of about equal size, which grows with the table
beyond ``MOST`` ranges, from Spark's own sample of the order's key; an order should
be total, so that pages neither overlap nor leave rows out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.scalars import page_bounds
from shutterlake.sources import work

#: Rows of a range, about, and ranges at most: the driver holds their bounds and counts, and each is a folder.
ROWS, MOST = 1 << 16, 256


@dataclass(frozen=True)
class RankIndex:
    """Rows under ``folder`` and the count of each range."""

    rows: DataFrame
    counts: list[int]
    order: Callable[[], list[Column]]
    folder: str

    def total(self) -> int:
        """How many rows there are."""
        return sum(self.counts)

    def ranges(self, limit: int, offset: int) -> tuple[list[int], int]:
        """The ranges that hold the rows from ``offset`` on, and how many rows lie before the first of them."""
        found, before, first = [], 0, 0
        for i, n in enumerate(self.counts):
            if n and before < offset + limit and before + n > offset:
                first = first if found else before
                found.append(i)
            before += n
        return found, first

    def page(self, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """The rows from ``offset`` on, ``limit`` at most, both within the usual bounds."""
        limit, offset = page_bounds(limit, offset)
        found, before = self.ranges(limit, offset)
        return self.rows.where(F.col("__range").isin(found)).drop("__range").orderBy(*self.order()).offset(max(0, offset - before)).limit(limit)

    def drop(self) -> None:
        """Delete the index."""
        work.delete(self.rows.sparkSession, self.folder)


def build(rows: DataFrame, order: Callable[[], list[Column]], size: int = ROWS) -> RankIndex:
    """The index of ``rows`` in the order that ``order()`` gives; written to the shared folder."""
    spark, folder = rows.sparkSession, work.new_path(rows.sparkSession, "rank-index")
    flat = work.written(rows, "ranked")
    many = max(1, min(MOST, -(-flat.count() // size)))
    flat.repartitionByRange(many, *order()).withColumn("__range", F.spark_partition_id()).write.partitionBy("__range").parquet(folder)
    work.discard(flat)
    stored = spark.read.schema(rows.withColumn("__range", F.lit(0)).schema).parquet(folder)
    counts = {r["__range"]: r["n"] for r in stored.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    return RankIndex(stored, [counts.get(i, 0) for i in range(many)], order, folder)
