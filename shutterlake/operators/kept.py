"""Facets kept by signed changes: what a row adds is subtracted when it goes, so a dashboard reads counts and not the catalog.

Every image, description and score adds to counts (facet, value). An upsert takes
the old rows' shares away and adds the new ones'; a delete only takes away. Dates
are counted by day, so that the first and last are right after deletions too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import scalars as X


def _listed(rows: DataFrame, *pairs: tuple[str, Column]) -> DataFrame:
    """(facet, value) where the value is not null."""
    every = F.array(*[F.struct(F.lit(f).alias("facet"), v.cast("string").alias("value")) for f, v in pairs])
    return rows.select(F.inline(F.filter(every, lambda p: p["value"].isNotNull())))


def of_images(images: DataFrame) -> DataFrame:
    """What each image adds."""
    date, label = F.col("date_taken").cast("string"), F.col("color_label")
    named = F.when(F.trim(label) != "", X.ascii_lower(label))
    yes = lambda test: F.when(test, "")
    return _listed(images, ("total", F.lit("")), ("posted", yes(F.col("instagram_posted") == 1)), ("rated", yes(F.col("rating") >= 1)), ("rating", F.coalesce(F.col("rating").cast("string"), F.lit(""))), ("color", named), ("month", X.year_month(date)), ("day", F.substring(date, 1, 10)))


def of_descriptions(descriptions: DataFrame) -> DataFrame:
    """What each description adds."""
    yes = lambda test: F.when(test, "")
    flags = _listed(descriptions, ("described", F.lit("")), ("with_repetition", yes(F.col("has_repetition") == 1)), ("with_mood", yes(X.non_empty_json_list(F.col("mood_tags")))), ("with_colors", yes(X.non_empty_json_list(F.col("dominant_colors")))))
    moods = descriptions.where(X.non_empty_json_list(F.col("mood_tags"))).select(F.lit("mood").alias("facet"), F.explode(X.json_strings(F.col("mood_tags"))).alias("value"))
    return flags.unionByName(moods)


def of_scores(scores: DataFrame) -> DataFrame:
    """What each score adds: to its lens, and to the lens's histogram."""
    return _listed(scores, ("lens", F.col("perspective_slug")), ("score", F.concat_ws(" ", F.col("perspective_slug").cast("string"), F.col("score").cast("string"))))


def counted(shares: DataFrame) -> DataFrame:
    """(facet, value, n) of shares."""
    return shares.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def changed(kept: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """The kept counts less the shares of rows that went, with those of rows that came."""
    signed = kept.unionByName(counted(gone).withColumn("n", -F.col("n"))).unionByName(counted(come))
    return signed.groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n > 0")


def facets(kept: DataFrame, tags: int = 40) -> DataFrame:
    """The row of :func:`shutterlake.operators.catalog.facets`, from the counts alone: one aggregation."""
    of = lambda facet: F.col("facet") == facet
    count = lambda facet: F.coalesce(F.sum(F.when(of(facet), F.col("n"))), F.lit(0)).alias(facet)
    listed = lambda facet, *of_it: F.array_sort(F.collect_list(F.when(of(facet), F.struct(*of_it))))
    # counts are a row for each value: moods beyond the first ones are cut before they are collected
    moods = kept.where(of("mood")).orderBy(F.desc("n"), "value").limit(tags)
    rows = kept.where(~F.col("facet").isin("mood", "month", "score", "rating")).unionByName(moods)
    return rows.agg(
        *map(count, ("total", "posted", "rated", "described", "with_repetition", "with_mood", "with_colors")),
        listed("color", F.col("value").alias("color_label"), F.col("n")).alias("color_labels"),
        F.transform(listed("mood", (-F.col("n")).alias("n"), F.col("value")), lambda m: m["value"]).alias("top_moods"),
        F.coalesce(F.min(F.when(of("day"), F.col("value"))), F.lit("")).alias("earliest"),
        F.coalesce(F.max(F.when(of("day"), F.col("value"))), F.lit("")).alias("latest"),
        F.sort_array(F.collect_list(F.when(of("lens"), F.col("value")))).alias("perspectives"),
    )
