"""Audit of how filters interact: every order of five filters replayed over all documents.

Each document's failures are five bits. Its row meets the 120 orders (a table of
fixed size, so it is broadcast), the place of its first failure in each order is
computed, the five steps are exploded, and conditional counts by part, order and
step are combined within each task before they are shuffled. Nothing but counts
leaves a task: parts x 600 rows of them.

A repeated text is told by its digest: the document with the least id of a digest
is the one that passes. The join that finds it goes by id, so a text with a third
of all copies is no hot key; the least ids are combined within tasks.

Rows: a null text is an empty one (and equal to it). A null language is the part
''. A document without an id repeats nothing, and nothing repeats it; it has no
label. Repeated rows count each; an id repeats no text of its own. Where a
document has several labels, one that says so is enough. An empty table gives no
rows. Further columns are not read, whatever they are called.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.common import discard, written

#: The filters, each with its bit.
FILTERS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
#: What stands between words, and the characters of filter D.
BETWEEN_WORDS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def failures(text: Column) -> Column:
    """The bits of the filters A to D that a text (null: empty) fails; each looks at the text alone."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, BETWEEN_WORDS), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    chars = F.length(whole).cast("long")
    capitals = chars - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * chars, "D": whole.rlike(SYMBOLS)}
    return reduce(lambda a, b: a + b, [F.when(tests[f], FILTERS[f]).otherwise(0) for f in tests])


def flags(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """(part, bits, good, toxic) of every document; reads the texts once and writes no more than a digest of each."""
    told = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("digest"), failures(F.col(f"`{text}`")).alias("bits"))
    told = written(told, "flags")
    first = told.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    repeats = F.col("id").isNotNull() & F.col("first").isNull()
    no = F.lit(False)
    joined = told.join(first, ["id", "digest"], "left").join(known, "id", "left")
    out = joined.select("part", (F.col("bits") + F.when(repeats, FILTERS["E"]).otherwise(0)).alias("bits"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    out._work_path = told._work_path
    return out


def orders(spark: SparkSession, filters: dict[str, int] = FILTERS) -> DataFrame:
    """(filter_order, masks): every order of the filters with their bits."""
    rows = [("".join(p), [filters[f] for f in p]) for p in permutations(sorted(filters))]
    return spark.createDataFrame(rows, "filter_order string, masks array<int>")


def replay(flagged: DataFrame, filters: dict[str, int] = FILTERS) -> DataFrame:
    """The counts of every (part, filter_order, step) over rows (part, bits, good, toxic).

    kept: left after the step. removed: first failed here. redundant: fails here,
    but was removed before. unique_fails: fails this filter and no other.
    good_lost, toxic_lost: removed here and labelled so. shapley: what the step's
    filter removed, summed over all orders.
    """
    steps = range(len(filters))
    met = flagged.crossJoin(F.broadcast(orders(flagged.sparkSession, filters)))
    fails = [F.col("bits").bitwiseAND(F.col("masks")[k]) != 0 for k in steps]
    place = reduce(lambda rest, k: F.when(fails[k], k + 1).otherwise(rest), reversed(steps), F.lit(len(filters) + 1))
    first = met.select("part", "filter_order", "bits", "good", "toxic", "masks", place.alias("place"))
    each = first.select("part", "filter_order", "bits", "good", "toxic", "place", F.posexplode("masks").alias("k", "mask")).withColumn("step", F.col("k") + 1)
    here, failed = F.col("place") == F.col("step"), F.col("bits").bitwiseAND(F.col("mask")) != 0
    counts = each.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("place") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(failed & (F.col("place") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("bits") == F.col("mask")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    counts = counts.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    shares = counts.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return counts.join(shares, ["part", "filter"]).drop("filter")


def interactions(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """:func:`replay` over all documents; the result, 600 rows a part, is written and the work table deleted."""
    flagged = flags(docs, labels, text, doc_id, part)
    out = written(replay(flagged), "audit")
    discard(flagged)
    return out
