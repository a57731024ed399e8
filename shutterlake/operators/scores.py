"""Scores: best of an image, percentiles within a lens, ranking, versions, and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import scalars as X


def current(scores: DataFrame) -> DataFrame:
    """The current rows of a versioned score table."""
    return scores.where("is_current = 1")


def attempted(scores: DataFrame, perspectives: DataFrame) -> DataFrame:
    """Scores of active lenses that were given: the population of all identity queries."""
    lenses = perspectives.where("active = 1").select(F.col("slug").alias("perspective_slug"))
    return scores.where(F.coalesce("not_attempted", F.lit(0)) == 0).join(lenses, "perspective_slug", "left_semi")


def best_score(scores: DataFrame) -> DataFrame:
    """(image_key, score, perspective_slug): the best score of an image, ties to the least slug."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "perspective_slug")).alias("b")
    return scores.groupBy("image_key").agg(best).select("image_key", (-F.col("b.s")).alias("score"), F.col("b.perspective_slug"))


def percentiles(population: DataFrame) -> DataFrame:
    """``population`` with ``pct``, the midrank percentile of the score within its lens, and ``pct_6``, that rounded to six places.

    The midrank of a score depends on the counts of scores only, so the ranks
    come from the histogram of each lens, which is as small as the score range
    and is joined back; no lens is sorted, however many images it has. Rounding
    is done there too, and not for each row. Both the histogram and the rows read
    ``population``: write it first where it costs more than a scan.
    """
    counts = population.groupBy("perspective_slug", "score").agg(F.count(F.lit(1)).alias("tied"))
    lens = Window.partitionBy("perspective_slug")
    n = F.sum("tied").over(lens)
    below = F.sum("tied").over(lens.orderBy("score")) - F.col("tied")
    rank = below + (F.col("tied") + 1) / F.lit(2.0)
    table = counts.select("perspective_slug", "score", F.when(n == 1, F.lit(1.0)).otherwise((rank - 1) / (n - 1)).alias("pct"))
    # scores are whole numbers from 1 to 10, so this is ten rows a lens
    return population.join(F.broadcast(table.withColumn("pct_6", X.exact_round(F.col("pct"), 6))), ["perspective_slug", "score"])


def rounded(pct: DataFrame) -> Column:
    """The percentile to six places: as it was worked out with the percentiles, else here."""
    return F.col("pct_6") if "pct_6" in pct.columns else X.exact_round(F.col("pct"), 6)


def peaks(pct: DataFrame, min_perspectives: int = 1) -> DataFrame:
    """(image_key, peak, coverage, eligible): the best rounded percentile of an image."""
    return pct.groupBy("image_key").agg(F.max(rounded(pct)).alias("peak"), F.count(F.lit(1)).alias("coverage")).withColumn("eligible", F.col("coverage") >= min_perspectives)


def peak_details(pct: DataFrame, perspectives: DataFrame, min_perspectives: int = 1) -> DataFrame:
    """:func:`peaks` with ``per_perspective``, the image's lenses in order: slug, display_name, score, percentile."""
    named = pct.join(perspectives.select(F.col("slug").alias("perspective_slug"), "display_name"), "perspective_slug", "left")
    one = F.struct("perspective_slug", F.coalesce("display_name", F.col("perspective_slug").cast("string")).alias("display_name"), "score", rounded(pct).alias("percentile"))
    listed = named.groupBy("image_key").agg(F.array_sort(F.collect_list(one)).alias("per_perspective"))
    peak = F.array_max(F.transform("per_perspective", lambda p: p["percentile"]))
    return listed.select("image_key", peak.alias("peak"), F.size("per_perspective").cast("long").alias("coverage"), (F.size("per_perspective") >= min_perspectives).alias("eligible"), "per_perspective")


def peak_meta(peak: DataFrame, images: DataFrame, perspectives: DataFrame) -> DataFrame:
    """One row: active_perspectives, total_catalog_images, scored_any_count, eligible_count (before stacks collapse)."""
    counts = peak.agg(F.count(F.lit(1)).alias("scored_any_count"), F.count_if("eligible").alias("eligible_count"))
    active = perspectives.where("active = 1").agg(F.sort_array(F.collect_set("slug")).alias("active_perspectives"))
    total = images.agg(F.count(F.lit(1)).alias("total_catalog_images"))
    return active.crossJoin(total).crossJoin(counts)


def aggregate(population: DataFrame, min_perspectives: int = 1) -> DataFrame:
    """(image_key, mean_score, coverage, eligible, scores): the equal-weight mean over lenses."""
    listed = F.sort_array(F.collect_list(F.struct("perspective_slug", "score"))).alias("scores")
    means = population.groupBy("image_key").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("coverage"), listed)
    return means.withColumns({"mean_score": X.exact_round(F.col("mean_score"), 4), "eligible": F.col("coverage") >= min_perspectives}).select("image_key", "mean_score", "coverage", "eligible", "scores")


def rank_best_photos(pct: DataFrame, images: DataFrame, hidden: DataFrame, limit: int = 50, offset: int = 0, min_perspectives: int = 1, newest_first: bool = True, posted: bool | None = None) -> DataFrame:
    """The page of images by peak percentile; ``hidden`` keys (stack members that do not represent) drop out after the percentiles."""
    eligible = peaks(pct, min_perspectives).where("eligible").join(hidden.select(F.col("key").alias("image_key")), "image_key", "left_anti")
    rows = eligible.join(images.select(F.col("key").alias("image_key"), "date_taken", "instagram_posted"), "image_key", "left")
    if posted is not None:
        rows = rows.where(F.coalesce("instagram_posted", F.lit(0)) == int(posted))
    date = F.coalesce(F.col("date_taken").cast("string"), F.lit(""))
    ordered = rows.orderBy(F.desc("peak"), date.desc() if newest_first else date.asc(), F.asc("image_key"))
    return ordered.offset(offset).limit(limit).select("image_key", "peak", "coverage", "date_taken", "instagram_posted")


def coverage(scores: DataFrame, perspectives: DataFrame) -> DataFrame:
    """(slug, display_name, active, images): images scored under each lens, zero included."""
    counts = scores.groupBy(F.col("perspective_slug").alias("slug")).agg(F.countDistinct("image_key").alias("images"))
    return perspectives.select("slug", "display_name", "active").join(counts, "slug", "left").select("slug", "display_name", "active", F.coalesce("images", F.lit(0)).alias("images"))


def distinct_slugs(scores: DataFrame) -> DataFrame:
    """(perspective_slug): the lenses with a current score, in order."""
    return scores.select("perspective_slug").distinct().orderBy("perspective_slug")


def unscored_on_active(images: DataFrame, scores: DataFrame, perspectives: DataFrame) -> DataFrame:
    """(slug, images): images without a score under each active lens.

    Counting what is there and subtracting needs no cross product of images and
    lenses; scores of unknown images do not count.
    """
    known = scores.join(images.select(F.col("key").alias("image_key")), "image_key", "left_semi")
    done = known.groupBy(F.col("perspective_slug").alias("slug")).agg(F.countDistinct("image_key").alias("n"))
    total = images.agg(F.countDistinct("key").alias("total"))
    lenses = perspectives.where("active = 1").select("slug").join(done, "slug", "left")
    return lenses.crossJoin(F.broadcast(total)).select("slug", (F.col("total") - F.coalesce("n", F.lit(0))).alias("images"))


def images_missing_active(images: DataFrame, scores: DataFrame, perspectives: DataFrame) -> DataFrame:
    """Keys of images that lack a score under some active lens."""
    lenses = perspectives.where("active = 1").select(F.col("slug").alias("perspective_slug"))
    have = scores.join(lenses, "perspective_slug", "left_semi").groupBy(F.col("image_key").alias("key")).agg(F.countDistinct("perspective_slug").alias("n"))
    wanted = lenses.agg(F.count(F.lit(1)).alias("wanted"))
    return images.select("key").join(have, "key", "left").crossJoin(F.broadcast(wanted)).where(F.coalesce("n", F.lit(0)) < F.col("wanted")).select("key")


def without_score(images: DataFrame, scores: DataFrame) -> DataFrame:
    """Keys of images with no score."""
    return images.select("key").join(scores.select(F.col("image_key").alias("key")), "key", "left_anti")


def scoring_at_least(scores: DataFrame, perspectives: DataFrame, least: int = 9) -> DataFrame:
    """(images): images with such a score under an active lens."""
    lenses = perspectives.where("active = 1").select(F.col("slug").alias("perspective_slug"))
    return scores.where(F.col("score") >= least).join(lenses, "perspective_slug", "left_semi").agg(F.countDistinct("image_key").alias("images"))


def work_triples(images: DataFrame, perspectives: DataFrame, done: list[DataFrame]) -> DataFrame:
    """(image_key, perspective_slug) still to score: all pairs, less those in each table of ``done``.

    What is done is given by :func:`current_for_version`, :func:`done_by_model`
    and a checkpoint's pairs. The lenses are a handful, so they are exploded from
    one array rather than cross joined.
    """
    lenses = perspectives.where("active = 1").agg(F.sort_array(F.collect_set("slug")).alias("slugs"))
    pairs = images.select(F.col("key").alias("image_key")).crossJoin(F.broadcast(lenses)).select("image_key", F.explode("slugs").alias("perspective_slug"))
    for table in done:
        pairs = pairs.join(table.select("image_key", "perspective_slug"), ["image_key", "perspective_slug"], "left_anti")
    return pairs


def current_for_version(scores: DataFrame, versions: DataFrame) -> DataFrame:
    """Pairs whose current score was given under the lens's present (perspective_slug, prompt_version)."""
    return current(scores).join(versions.select("perspective_slug", "prompt_version"), ["perspective_slug", "prompt_version"], "left_semi").select("image_key", "perspective_slug").distinct()


def done_by_model(rows: DataFrame, model: str) -> DataFrame:
    """The rows of scores or descriptions that a model gave."""
    return rows.where(F.col("model_used") == model)


def delete_version(scores: DataFrame, versions: DataFrame) -> DataFrame:
    """Scores without those of the given (image_key, image_type, perspective_slug, prompt_version).

    Keys shrink so much in a shuffle that partitions merged up to a size have millions
    of rows. So what is left is dealt to a given number of partitions, which are not
    merged, and what follows does not hold its rows beside the join's sort.
    """
    keys = ["image_key", "image_type", "perspective_slug", "prompt_version"]
    tasks = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scores.join(versions, keys, "left_anti").select(*scores.columns).repartition(tasks, *keys)


def supersede(old: DataFrame, new: DataFrame) -> DataFrame:
    """Versions after ``new`` rows came in: a new row replaces the same version, and is the only current one of its image and lens.

    Rows are dealt once, to a given number of partitions that are not merged by size
    (see :func:`delete_version`); all three windows find their rows there.
    """
    group = ["image_key", "image_type", "perspective_slug"]
    tasks = int(old.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1))).repartition(tasks, *group)
    version = Window.partitionBy(*group, "prompt_version").orderBy(F.desc("__new"), F.desc("scored_at"), F.desc("id"))
    last = Window.partitionBy(*group).orderBy(F.desc("__new"), F.desc("scored_at"), F.desc("id"))
    rows = marked.withColumn("__v", F.row_number().over(version)).where("__v = 1")
    touched = F.max("__new").over(Window.partitionBy(*group)) == 1
    is_current = F.when(touched, (F.row_number().over(last) == 1).cast("long")).otherwise(F.col("is_current"))
    return rows.withColumn("is_current", is_current).drop("__v", "__new")


def history(scores: DataFrame) -> DataFrame:
    """Newest first, by lens."""
    return scores.orderBy("image_key", "perspective_slug", F.desc("scored_at"), F.desc("id"))


def backfill_legacy(descriptions: DataFrame, scores: DataFrame) -> DataFrame:
    """Score rows out of the legacy JSON maps, where an image and lens has no current score."""
    cells = descriptions.select("image_key", "image_type", "model_used", "described_at", F.explode(F.try_variant_get(F.try_parse_json("perspectives"), "$", "map<string,variant>")).alias("perspective_slug", "cell"))
    rows = cells.withColumn("score", X.typed_score(F.try_variant_get("cell", "$.score", "variant"))).where("score is not null")
    fresh = rows.join(current(scores).select("image_key", "image_type", "perspective_slug"), ["image_key", "image_type", "perspective_slug"], "left_anti")
    return fresh.select("image_key", "image_type", "perspective_slug", "score", F.try_variant_get("cell", "$.analysis", "string").alias("rationale"), "model_used", F.lit("legacy").alias("prompt_version"), F.col("described_at").alias("scored_at"), F.lit(1).cast("long").alias("is_current"))
