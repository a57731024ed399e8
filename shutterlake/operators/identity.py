"""What a photographer's scores say of them: votes, signature, exemplars, words, and what to post next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.scalars import exact_round, log_odds, strength, z_score
from shutterlake.functions.udfs import binom_sf
from shutterlake.operators.scores import rounded
from shutterlake.sources.work import written

#: Lenses an image needs to vote; the share of the catalog under which a lens is of low coverage; the level of a crown.
MIN_LENSES, LOW_COVERAGE, LEVEL = 2, 0.5, 0.05


def votes(pct: DataFrame) -> DataFrame:
    """(perspective_slug, votes, photos_on, expected, population): images of two lenses or more vote for their strictly best one.

    A tie is no vote, but counts for photos_on and, with 1/k of k lenses, for what
    chance would give. ``population`` is the number of voting images.
    """
    # an image's lenses are few, so they are one sorted list
    lenses = F.array_sort(F.collect_list(F.struct("perspective_slug", "pct"))).alias("lenses")
    top = F.array_max(F.transform("lenses", lambda x: x["pct"]))
    images = pct.groupBy("image_key").agg(lenses).where(F.size("lenses") >= MIN_LENSES).select("lenses", F.size("lenses").alias("k"), top.alias("top"))
    tops = F.size(F.filter("lenses", lambda x: x["pct"] == F.col("top")))
    voters = images.select("k", "top", tops.alias("tops"), F.posexplode("lenses").alias("at", "lens")).select("k", "at", F.col("lens.perspective_slug").alias("perspective_slug"), ((F.col("lens.pct") == F.col("top")) & (F.col("tops") == 1)).alias("won"))
    rows = voters.groupBy("perspective_slug").agg(F.count_if("won").alias("votes"), F.count(F.lit(1)).alias("photos_on"), F.sum(1 / F.col("k")).alias("expected"), F.count_if(F.col("at") == 0).alias("firsts"))
    # one row a lens, so this window is as small as the list of lenses
    return rows.withColumn("population", F.sum("firsts").over(Window.partitionBy())).drop("firsts")


def signature(pct: DataFrame, catalog: DataFrame) -> DataFrame:
    """Votes with z, p_value, crowned, coverage, low_coverage and strength for each lens; ``catalog`` is (total), the images of the catalog.

    Chance is the mean of 1/k over the images that a lens is on, and those images
    are the trials.
    """
    rows = votes(pct).crossJoin(F.broadcast(catalog.select("total")))
    chance = F.col("expected") / F.col("photos_on")
    z = z_score(F.col("votes"), F.col("expected"), F.col("photos_on"))
    tail = F.when((chance > 0) & (chance < 1), binom_sf("votes", "photos_on", chance)).otherwise(1.0)
    out = rows.withColumns({"raw_z": z, "raw_p": tail, "share": F.col("photos_on") / F.col("total"), "rate": F.col("votes") / F.col("photos_on"), "chance": chance})
    out = out.withColumns({"z": exact_round(F.col("raw_z"), 2), "p_value": exact_round(F.col("raw_p"), 6), "crowned": (F.col("raw_p") < LEVEL) & (F.col("raw_z") > 0)})
    out = out.withColumns({"win_rate": exact_round(F.col("rate"), 6), "chance_rate": exact_round(F.col("chance"), 6), "coverage": exact_round(F.col("share"), 4), "low_coverage": F.col("share") < LOW_COVERAGE, "expected": exact_round(F.col("expected"), 4)})
    return out.withColumn("strength", strength(F.col("crowned"), F.col("z"))).drop("raw_z", "raw_p", "share", "rate", "chance", "total")


def sections(signature_rows: DataFrame) -> DataFrame:
    """All lenses with ``section``, the place among the sections shown, null for the other lenses; crowned lenses by z, and where there are none the one with most votes leads."""
    every = Window.partitionBy()
    fallback = ~F.max("crowned").over(every)
    lead = Window.orderBy(F.desc("crowned"), F.when(F.col("crowned"), F.lit(0)).otherwise(F.col("votes")).desc(), F.desc("z"), F.asc("perspective_slug"))
    placed = signature_rows.withColumns({"fallback": fallback, "place": F.row_number().over(lead)})
    shown = F.col("crowned") | (F.col("fallback") & (F.col("place") == 1))
    out = placed.withColumns({"section": F.when(shown, F.col("place")), "leads": F.col("fallback") & (F.col("place") == 1)})
    return out.withColumn("strength", strength(F.col("crowned"), F.col("z"), F.col("leads"))).drop("place")


def mirror(pct: DataFrame, hidden: DataFrame, catalog: DataFrame, perspectives: DataFrame, tokens: DataFrame, limit: int = 24) -> DataFrame:
    """One row a lens: its signature, display name, section, descriptors and first exemplars, and how many exemplars there are.

    Descriptors and exemplars are given for the sections only.
    """
    rows = sections(signature(pct, catalog)).join(perspectives.select(F.col("slug").alias("perspective_slug"), "display_name"), "perspective_slug", "left")
    shown = pct.join(hidden.select(F.col("key").alias("image_key")), "image_key", "left_anti").groupBy("perspective_slug").agg(F.count(F.lit(1)).alias("exemplar_total"))
    first = exemplars(pct, hidden, limit).groupBy("perspective_slug").agg(F.array_sort(F.collect_list(F.struct("place", "image_key", "pct", "purity"))).alias("exemplars"))
    words = descriptors(tokens).groupBy("perspective_slug").agg(F.array_sort(F.collect_list(F.struct("place", "token", "log_odds", "n"))).alias("descriptors"))
    out = rows.join(shown, "perspective_slug", "left").join(first, "perspective_slug", "left").join(words, "perspective_slug", "left")
    inside = F.col("section").isNotNull()
    return out.withColumns({"exemplar_total": F.coalesce("exemplar_total", F.lit(0)), "exemplars": F.when(inside, F.col("exemplars")), "descriptors": F.when(inside, F.col("descriptors"))})


def purity(pct: DataFrame) -> DataFrame:
    """``pct`` with ``purity``: points by which a lens leads the best other lens of the image, 0 where it is alone."""
    image = Window.partitionBy("image_key").orderBy(F.desc("pct"), F.asc("perspective_slug"))
    other = F.when(F.row_number().over(image) == 1, F.lead("pct").over(image)).otherwise(F.first("pct").over(image))
    apart = pct.withColumn("purity", (F.col("pct") - other) * 100)
    return apart.withColumn("purity", F.coalesce(exact_round(F.col("purity"), 1), F.lit(0.0)))


def exemplars(pct: DataFrame, hidden: DataFrame, limit: int = 12, offset: int = 0) -> DataFrame:
    """A page of the images of each lens: percentile, purity, key; stacks are collapsed after both are known."""
    shown = purity(pct).join(hidden.select(F.col("key").alias("image_key")), "image_key", "left_anti")
    order = Window.partitionBy("perspective_slug").orderBy(F.desc("pct"), F.desc("purity"), F.asc("image_key"))
    return shown.withColumn("place", F.row_number().over(order)).where((F.col("place") > offset) & (F.col("place") <= offset + limit)).select("perspective_slug", "place", "image_key", rounded(pct).alias("pct"), "purity")


def descriptors(tokens: DataFrame, least: int = 5, top: int = 15) -> DataFrame:
    """(perspective_slug, token, n, log_odds, place) from one row for each token of each rationale."""
    own = tokens.groupBy("perspective_slug", "token").agg(F.count(F.lit(1)).alias("n"))
    lens = own.groupBy("perspective_slug").agg(F.sum("n").alias("lens_tokens"))
    corpus = own.groupBy("token").agg(F.sum("n").alias("corpus_n"))
    total = own.agg(F.sum("n").alias("corpus_tokens"))
    rows = own.where(F.col("n") >= least).join(lens, "perspective_slug").join(corpus, "token").crossJoin(F.broadcast(total))
    scored = rows.withColumn("raw", log_odds(F.col("n"), F.col("lens_tokens"), F.col("corpus_n"), F.col("corpus_tokens"))).withColumn("log_odds", exact_round(F.col("raw"), 4))
    order = Window.partitionBy("perspective_slug").orderBy(F.desc("raw"), F.desc("n"), F.asc("token"))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("perspective_slug", "token", "n", "log_odds", "place")


def dominant_lens(pct: DataFrame) -> DataFrame:
    """(image_key, lens): the lens of the highest percentile, ties to the least slug."""
    first = F.min(F.struct((-F.col("pct")).alias("p"), "perspective_slug")).alias("f")
    return pct.groupBy("image_key").agg(first).select("image_key", F.col("f.perspective_slug").alias("lens"))


def suggest_next(pct: DataFrame, images: DataFrame, limit: int = 50, offset: int = 0, newest_first: bool = True, crowned: DataFrame | None = None, min_perspectives: int = 1) -> DataFrame:
    """Unposted images by peak, each with its lens, whether that is a signature (a slug of ``crowned``), and reason codes.

    The code high_score_unposted is for the top tenth of the unposted, which
    begins at place round(0.9 (n - 1)), halves to even, of the sorted peaks,
    found from their histogram: peaks are rounded, so it stays small. Stacks are
    not collapsed.
    """
    one = pct.select("image_key", "perspective_slug", rounded(pct).alias("pct")).groupBy("image_key").agg(F.max("pct").alias("peak"), F.count(F.lit(1)).alias("coverage"), F.min(F.struct((-F.col("pct")).alias("p"), "perspective_slug")).alias("f"))
    peak = one.where(F.col("coverage") >= min_perspectives).select("image_key", "peak", "coverage", F.col("f.perspective_slug").alias("lens"))
    known = images.select(F.col("key").alias("image_key"), "date_taken", (F.coalesce("instagram_posted", F.lit(0)) != 0).alias("posted"))
    # scored images that the catalog lacks count as unposted; the rows are written, since the cut and the page both need them
    rows = written(peak.join(known, "image_key", "left").where(~F.coalesce("posted", F.lit(False))).drop("posted"), "unposted")
    counts = rows.groupBy("peak").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.select("peak", F.sum("n").over(Window.orderBy("peak")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    cut = upto.where(F.col("upto") > F.rint(0.9 * (F.col("total") - 1))).agg(F.min("peak").alias("p90"))
    flagged = rows.crossJoin(F.broadcast(cut)).withColumn("top_tenth", F.col("peak") >= F.coalesce("p90", F.lit(1.0)))
    flagged = flagged.withColumn("codes", F.when(F.col("top_tenth"), F.array(F.lit("high_score_unposted"))).otherwise(F.array(F.lit("eligible_unposted"))))
    if crowned is not None:
        named = crowned.select(F.col("perspective_slug").alias("lens")).distinct().withColumn("is_signature", F.lit(True))
        flagged = flagged.join(F.broadcast(named), "lens", "left").withColumn("is_signature", F.coalesce("is_signature", F.lit(False)))
    else:
        flagged = flagged.withColumn("is_signature", F.lit(False))
    date = F.coalesce(F.col("date_taken").cast("string"), F.lit(""))
    page = flagged.orderBy(F.desc("peak"), date.desc() if newest_first else date.asc(), F.asc("image_key")).offset(offset).limit(limit)
    return page.select("image_key", "peak", "coverage", "lens", "is_signature", "top_tenth", "codes", "date_taken")


def reasons(row_lens: str, is_signature: bool, peak: float, codes: list[str]) -> list[str]:
    """The sentences that go with a suggestion's codes."""
    out = [f"Among the highest peaks of scored images that were not posted (peak {peak:.4f})."] if "high_score_unposted" in codes else []
    if row_lens:
        out.append(f"Its peak lens is {row_lens}" + (", a signature of yours." if is_signature else "."))
    if "eligible_unposted" in codes:
        out.append("Not posted, and scored under enough lenses; ranked by its peak.")
    return out


def insights(images: DataFrame, scores: DataFrame, perspectives: DataFrame, stacks: DataFrame, pending: DataFrame) -> DataFrame:
    """One row of the landing page: catalog_images, scoring_9_plus, burst_stacks, pending_stack_suggestions, unscored_on_active_perspectives, no_current_score, and perspective_coverage, a struct for each lens."""
    from shutterlake.operators import scores as S

    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    lenses = S.coverage(scores, perspectives).agg(F.array_sort(F.collect_list(F.struct("slug", "display_name", "active", "images"))).alias("perspective_coverage"))
    parts = [
        S.scoring_at_least(scores, perspectives).withColumnRenamed("images", "scoring_9_plus"),
        one(stacks, "burst_stacks"),
        one(pending, "pending_stack_suggestions"),
        one(S.images_missing_active(images, scores, perspectives), "unscored_on_active_perspectives"),
        one(S.without_score(images, scores), "no_current_score"),
        lenses,
    ]
    # each part is one row
    out = one(images, "catalog_images")
    for part in parts:
        out = out.crossJoin(part)
    return out
