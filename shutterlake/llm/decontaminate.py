"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document when at least ``THRESHOLD`` of its distinct
five-word shingles occur there. Items are partitioned by size; each keeps a
MinHash sketch, its shingles of least hash, as many as the partition's largest
size n allows to be missing, plus one: n - ceil(n * threshold) + 1. Any document
that contains the item therefore holds a shingle of the sketch, however long it
is, and no containing document is missed. Documents are probed against the
sketches, and the candidates are verified by containment of the shingles
themselves. Everything is a DataFrame expression.

Words are runs of letters and digits in lower case; an item of fewer than five
words is one shingle, its whole sequence, found as such anywhere.

Rows: null or empty texts and items match nothing. Repeated rows give equal
pairs once. Null ids of items or documents match nothing, since a pair needs
both. Further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import discard, written

WIDTH, THRESHOLD = 5, 0.8
#: Upper ends of the items' size partitions grow by this factor.
GROWTH = 1.5
#: Sketch rows up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, span: Column) -> Column:
    """All shingles of ``span`` words, as texts; of fewer words, the whole sequence."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - span + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, span), " "))


def _items(benchmark: DataFrame, width: int, threshold: float) -> DataFrame:
    """(item_id, span, shingles, n, sketch): span is the shingles' width, fewer for short items."""
    words = benchmark.where("item_id is not null and text is not null").select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    span = F.least(F.size("words"), F.lit(width))
    # an item given twice counts with the shingles of all its rows
    each = words.select("item_id", span.alias("span"), F.explode(shingles_of(F.col("words"), span)).alias("shingle")).distinct()
    sets = each.groupBy("item_id", "span").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("shingle").alias("h"), "shingle"))).alias("s"))
    n = F.size("s")
    # the partition's largest size
    top = F.ceil(F.pow(F.lit(GROWTH), F.ceil(F.log(GROWTH, n.cast("double")))))
    length = F.greatest(n, top) - F.ceil(F.greatest(n, top) * threshold - 1e-9) + 1
    return sets.select("item_id", "span", n.alias("n"), F.transform("s", lambda x: x["shingle"]).alias("shingles"), F.transform(F.slice("s", F.lit(1), F.least(length, n).cast("int")), lambda x: x["h"]).alias("sketch"))


def contained(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_common, n_item, containment) of every item that a document of ``docs`` (doc_id, text) contains."""
    items = written(_items(benchmark, width, threshold), "items")
    sketches = items.select("span", "item_id", F.explode("sketch").alias("h"))
    spans = [r["span"] for r in items.select("span").distinct().collect()]
    small = sketches.count() <= BROADCAST_ROWS
    base = docs.where("doc_id is not null and text is not null").select("doc_id", "text", words_of(F.col("text")).alias("words"))
    # beside broadcast sketches a text goes along with its few hits, so that the documents are read once;
    # where every shingle is shuffled, two hashes name the text, and the texts of the hits are read again
    named = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    carried = F.col("text") if small else named
    found = None
    for span in sorted(set(spans)):
        # columns side by side, each one word later: a row for each shingle, hashed in generated code
        later = F.arrays_zip(*[F.slice("words", F.lit(k + 1), F.greatest(F.size("words"), F.lit(1))).alias(f"w{k}") for k in range(span)])
        rows = base.select("doc_id", carried, F.inline(later)).toDF("doc_id", "carried", *[f"w{k}" for k in range(span)])
        rows = rows.where(F.col(f"w{span - 1}").isNotNull()).withColumn("h", F.xxhash64(F.concat_ws(" ", *[f"w{k}" for k in range(span)])))
        probes = sketches.where(F.col("span") == span).select("h", "item_id")
        hits = rows.join(F.broadcast(probes) if small else probes, "h").select("doc_id", "item_id", "carried")
        found = hits if found is None else found.union(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_common long, n_item long, containment double")
    hits = None
    if small:
        candidates = found.groupBy("doc_id", "item_id", F.xxhash64("carried").alias("t")).agg(F.first("carried").alias("text"))
    else:
        hits = written(found.distinct(), "hits")
        wanted = hits.select("doc_id", "carried").distinct()
        texts = base.select("doc_id", "text", named.alias("carried")).distinct().join(wanted, ["doc_id", "carried"], "left_semi")
        candidates = hits.join(texts, ["doc_id", "carried"])
    both = candidates.join(items.select("item_id", "span", "shingles", "n"), "item_id")
    common = F.size(F.array_intersect(shingles_of(F.col("words"), F.col("span")), "shingles"))
    counted = both.withColumn("words", words_of(F.col("text"))).select("doc_id", "item_id", common.cast("long").alias("n_common"), F.col("n").cast("long").alias("n_item"))
    share = F.col("n_common") / F.col("n_item")
    pairs = counted.groupBy("doc_id", "item_id").agg(F.max("n_common").alias("n_common"), F.max("n_item").alias("n_item")).withColumn("containment", share).where(F.col("n_common") >= threshold * F.col("n_item") - 1e-9)
    out = written(pairs, "contained")
    discard(items, *([hits] if hits is not None else []))
    return out
