"""Cosine nearest neighbours and similarity groups, through :mod:`shutterlake.operators.vector_index`."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.scalars import match_label
from shutterlake.operators import vector_index as I
from shutterlake.operators.catalog import newest_first
from shutterlake.operators.model_calls import call


def nearest(queries: DataFrame, vectors: DataFrame, k: int, with_self: bool = True) -> DataFrame:
    """(seed, key, similarity, rank): the ``k`` vectors nearest to each query, both (key, embedding); ties by key."""
    return I.search(I.index_of(vectors.select("key", "embedding")), queries, k, with_self)


def similar(seed: DataFrame, vectors: DataFrame, hidden: DataFrame, keep: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The page of images like the seed: the nearest are taken first, and only then the seed, hidden members and what ``keep`` lacks drop out."""
    k = min(500, max(50, 20 * (offset + limit)))
    found = nearest(seed, vectors, k).where("seed <> key").join(hidden, "key", "left_anti").join(keep.select("key"), "key", "left_semi")
    return found.orderBy("rank").offset(offset).limit(limit).select("seed", "key", "similarity", match_label(F.col("similarity")).alias("why_matched"))


def similar_pairs(vectors: DataFrame, hidden: DataFrame, blank: DataFrame, per_seed: int = 8, threshold: float = 0.9) -> DataFrame:
    """(seed, key, similarity, n): of each seed that is neither hidden nor blank its first ``per_seed`` shown neighbours, if they reach the threshold.

    The nearest 20 * ``per_seed`` are taken first (50 to 500), and only then the
    seed and hidden ones drop out. What reaches the threshold is the beginning of
    that ranking, so the join need not look below it.
    """
    per_seed = max(1, min(50, per_seed))
    k = min(I.KEEP, max(50, 20 * per_seed))
    raw = I.within(I.index_of(vectors.select("key", "embedding")), threshold, k)
    unusable = hidden.select(F.col("key").alias("seed")).union(blank.select("key")).distinct()
    shown = raw.where("seed <> key").join(hidden.select("key"), "key", "left_anti").join(unusable, "seed", "left_anti")
    again = Window.partitionBy("seed").orderBy("rank")
    return shown.withColumn("n", F.row_number().over(again)).where(F.col("n") <= per_seed).drop("rank")


def _with_pair(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"key_a": F.least("seed", "key"), "key_b": F.greatest("seed", "key")})


def similarity_candidates(pairs: DataFrame, seeds: DataFrame, blank: DataFrame, rejections: DataFrame) -> DataFrame:
    """(seed_key, candidate_key, similarity, rank) from :func:`similar_pairs`, each unordered pair once, without blank candidates and rejected pairs.

    ``seeds`` is (key, seed_rank), the newest first. All filters treat a pair's
    sides alike, so the row that survives is the one of the least seed rank.
    """
    good = _with_pair(pairs).join(rejections.select("key_a", "key_b"), ["key_a", "key_b"], "left_anti").join(blank.select("key"), "key", "left_anti")
    ranked = good.join(seeds.select(F.col("key").alias("seed"), "seed_rank"), "seed")
    once = Window.partitionBy("key_a", "key_b").orderBy("seed_rank")
    kept = ranked.withColumn("o", F.row_number().over(once)).where("o = 1")
    place = Window.partitionBy("seed").orderBy("n")
    return kept.withColumn("rank", F.row_number().over(place)).select(F.col("seed").alias("seed_key"), F.col("key").alias("candidate_key"), "similarity", "rank")


def similarity_groups(candidates: DataFrame) -> DataFrame:
    """(seed_key, candidate_count, best_similarity)."""
    return candidates.groupBy("seed_key").agg(F.count(F.lit(1)).alias("candidate_count"), F.max("similarity").alias("best_similarity"))


def similarity_counters(vectors: DataFrame, hidden: DataFrame, blank: DataFrame, rejections: DataFrame, pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row that says what became of the seeds: embedded images, groups and candidates made, and what was skipped.

    A hidden seed is non-primary; a blank one counts as blank, and so does each
    blank candidate of a seed, unless the pair was rejected; each side of a
    rejected pair that finds the other counts. A seed that is neither hidden nor
    blank and whose vector is null has no embedding. ``pairs`` and ``candidates``
    are of :func:`similar_pairs` and :func:`similarity_candidates`.
    """
    yes = F.lit(True)
    marks = {"is_hidden": hidden, "is_blank": blank}
    seeds = vectors.select("key", F.col("embedding").isNull().alias("none"))
    for name, keys in marks.items():
        seeds = seeds.join(keys.select("key").distinct().withColumn(name, yes), "key", "left")
    primary, shown = F.col("is_hidden").isNull(), F.col("is_hidden").isNull() & F.col("is_blank").isNull()
    one = seeds.agg(F.count(F.lit(1)).alias("embedded_catalog_images"), F.count_if(~primary).alias("skipped_non_primary"), F.count_if(shown & F.col("none")).alias("skipped_no_embedding"), F.count_if(primary & F.col("is_blank").isNotNull()).alias("blank_seeds"))
    refused = _with_pair(pairs).join(rejections.select("key_a", "key_b").distinct().withColumn("refused", yes), ["key_a", "key_b"], "left").join(blank.select("key").distinct().withColumn("is_blank", yes), "key", "left")
    two = refused.agg(F.count("refused").alias("skipped_rejected"), F.count_if(F.col("refused").isNull() & F.col("is_blank").isNotNull()).alias("blank_candidates"))
    made = candidates.agg(F.countDistinct("seed_key").alias("groups_created"), F.count(F.lit(1)).alias("candidates_created"))
    return one.crossJoin(two).crossJoin(made).withColumn("skipped_blank_frame", F.col("blank_seeds") + F.col("blank_candidates")).drop("blank_seeds", "blank_candidates")


def pin_candidates(seed: DataFrame, vectors: DataFrame, hidden: DataFrame, most: int = 600) -> DataFrame:
    """The seed, then its nearest primary images."""
    found = nearest(seed, vectors, 500).where("seed <> key").join(hidden, "key", "left_anti").where(F.col("rank") <= most)
    return seed.select("key", F.lit(0).alias("rank")).union(found.select("key", "rank"))


def embedded_newest_first(images: DataFrame, vectors: DataFrame) -> DataFrame:
    """(key, date_taken) of the images that have a row in ``vectors`` (key), newest first."""
    return newest_first(images.join(vectors.select("key").distinct(), "key", "left_semi")).select("key", "date_taken")


def encode(rows: DataFrame, model: Callable | Sequence[Callable], column: str, size: int, waits: Sequence[float] = (2, 8, 32)) -> DataFrame:
    """``rows`` (key, ``column``) with vectors of an injected model: a function from a list of values to a matrix.

    Of several models the first that answers serves a batch; passing failures are
    met as in :func:`~shutterlake.operators.model_calls.call`.
    """
    models = [model] if callable(model) else list(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, _ = call(models, batch[column].tolist(), waits)
            out = np.asarray(found, dtype=np.float32).reshape(len(batch), size)
            out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"key": batch["key"], "embedding": list(out)})

    return rows.select("key", column).mapInPandas(run, f"key {dict(rows.dtypes)['key']}, embedding array<float>")
