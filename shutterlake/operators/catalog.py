"""Catalog search: filters, joins, order, pages, facets and lookups."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import scalars as X
from shutterlake.functions.udfs import porter_stem, porter_tokens
from shutterlake.operators.text_index import TextIndex


@dataclass(frozen=True)
class CatalogFilter:
    """What a catalog search asks for; None or empty means no filter."""

    posted: bool | None = None
    month: str | None = None
    keyword: str | None = None
    min_rating: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    color_label: str | None = None
    analyzed: bool | None = None
    perspective: str | int | None = None
    min_score: int | None = None
    min_score_on_active: int | None = None
    burst_stack: bool | None = None
    description_search: str | None = None
    dominant_colors: list[str] = field(default_factory=list)
    mood_tags: list[str] = field(default_factory=list)
    has_repetition: bool | None = None
    restrict_to_keys: list | None = None


def catalog_base(images: DataFrame, stacks: DataFrame, descriptions: DataFrame | None = None, scores: DataFrame | None = None, perspective: str | int | None = None) -> DataFrame:
    """Images with stack, description and one lens's score; each join adds at most one row, and is made only when needed.

    ``stacks`` is (key, stack_id, representative_key, stack_size).
    """
    base = images.join(stacks.select("key", "stack_id", "representative_key", "stack_size"), "key", "left")
    if descriptions is not None:
        base = base.join(descriptions.withColumn("__described", F.lit(True)), "key", "left")
    if perspective is not None and scores is not None:
        one = scores.where(F.col("perspective_slug") == perspective).select(F.col("image_key").alias("key"), F.col("score").alias("lens_score"))
        base = base.join(one, "key", "left")
    return base


def predicates(f: CatalogFilter) -> list[Column]:
    """The filters as columns over :func:`catalog_base`."""
    c, out = F.col, []
    if f.posted is not None:
        out.append(c("instagram_posted") == int(f.posted))
    if f.month and len(f.month) == 6 and f.month.isdigit():
        out.append(X.year_month(c("date_taken")) == f.month)
    if f.keyword and f.keyword.strip():
        fields = ("keywords", "filename", "title", "description")
        out.append(reduce(lambda a, b: a | b, [F.coalesce(X.like_substring(c(x), f.keyword.strip()), F.lit(False)) for x in fields]))
    if f.min_rating is not None:
        out.append(c("rating") >= f.min_rating)
    if f.date_from:
        out.append(c("date_taken") >= f.date_from)
    if f.date_to:
        out.append(c("date_taken") <= f.date_to)
    if f.color_label and f.color_label.strip():
        out.append(X.ascii_lower(c("color_label")) == f.color_label.strip().lower())
    if f.analyzed is not None:
        out.append(c("__described").isNotNull() if f.analyzed else c("__described").isNull())
    if f.min_score is not None:
        if f.perspective is None:
            raise ValueError("min_score needs a perspective")
        out.append(c("lens_score") >= f.min_score)
    if f.burst_stack is not None:
        leads = c("stack_id").isNotNull() & (c("stack_size") > 1) & (c("key") == c("representative_key"))
        out.append(leads if f.burst_stack else ~F.coalesce(leads, F.lit(False)))
    if f.dominant_colors:
        out.append(X.json_any_of(c("dominant_colors"), f.dominant_colors))
    if f.mood_tags:
        out.append(X.json_any_of(c("mood_tags"), f.mood_tags))
    if f.has_repetition is not None:
        out.append(F.coalesce(c("has_repetition"), F.lit(0)) == int(f.has_repetition))
    if f.restrict_to_keys is not None:
        out.append(c("key").isin(*f.restrict_to_keys) if f.restrict_to_keys else F.lit(False))
    # a stack is shown by its representative only
    out.append(c("stack_id").isNull() | (c("key") == c("representative_key")))
    return out


def search(base: DataFrame, f: CatalogFilter, scores: DataFrame | None = None, perspectives: DataFrame | None = None, texts: DataFrame | TextIndex | None = None) -> DataFrame:
    """The rows that pass. ``texts`` is what ``description_search`` looks in: (key, text), with ``tokens`` or without, or an index of it."""
    out = reduce(lambda df, p: df.where(p), predicates(f), base)
    if f.min_score_on_active is not None:
        lenses = perspectives.where("active = 1").select(F.col("slug").alias("perspective_slug"))
        good = scores.where(F.col("score") >= f.min_score_on_active).join(lenses, "perspective_slug", "left_semi")
        out = out.join(good.select(F.col("image_key").alias("key")), "key", "left_semi")
    terms = X.search_terms(f.description_search)
    if terms:
        out = out.join(full_text(texts, terms).select("key"), "key", "left_semi")
    return out


def full_text(texts: DataFrame | TextIndex, terms: list[str]) -> DataFrame:
    """Rows of (key, text) that hold every term, after folding and stemming; from an index their keys.

    Where the rows carry ``tokens`` (see :func:`with_tokens`), those are searched
    and no text is read. Otherwise only texts that can match are stemmed: a word
    begins with its stem less the last letter, so a text of ASCII alone that lacks
    this beginning of some term drops out before.
    """
    stems = [porter_stem(t.lower()) for t in terms]
    if isinstance(texts, TextIndex):
        return texts.search(stems)
    if "tokens" not in texts.columns:
        plain = F.lower("text")
        begun = reduce(lambda a, b: a & b, [F.contains(plain, F.lit(s[: max(1, len(s) - 1)])) for s in stems])
        texts = with_tokens(texts.where(F.col("text").rlike(r"[^\x00-\x7F]") | begun))
    return texts.where(reduce(lambda a, b: a & b, [F.array_contains("tokens", s) for s in stems]))


def with_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their stems; store this to search often."""
    return texts.withColumn("tokens", porter_tokens(text))


def filter_in_order(base: DataFrame, keys: list, f: CatalogFilter, scores: DataFrame | None = None, perspectives: DataFrame | None = None, texts: DataFrame | TextIndex | None = None) -> DataFrame:
    """The rows of ``keys`` that pass the filters, in the caller's order."""
    return in_given_order(search(base, f, scores, perspectives, texts), keys)


def search_dispatch(images: DataFrame, texts: DataFrame | TextIndex, keyword: str | None = None, rating: int | None = None, color: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """One search of several: the keyword, else the rating, else the colour, else the dates; nothing asked for gives nothing."""
    if keyword:
        return search_by_keyword(images, texts, keyword)
    if rating is not None:
        return images.where(F.col("rating") >= rating)
    if color:
        return images.where(X.ascii_lower(F.col("color_label")) == color.lower())
    if date_from or date_to:
        date = F.col("date_taken").cast("string")
        out = images.where(date >= date_from) if date_from else images
        return out.where(date <= date_to) if date_to else out
    return images.limit(0)


def missing_hashes(images: DataFrame, column: str = "phash") -> DataFrame:
    """Keys of images without a hash, newest first."""
    return newest_first(images.where(F.col(column).isNull())).select("key")


def missing_visual_tags(images: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Keys of images whose description has no colour list, not even an empty one."""
    return images.join(descriptions.where("dominant_colors is null").select("key"), "key", "left_semi").select("key")


def newest_first(images: DataFrame) -> DataFrame:
    """Images by date, those without one last, then by key."""
    return images.orderBy(F.coalesce(F.col("date_taken").cast("string"), F.lit("")).desc(), F.desc("key"))


def api_rows(rows: DataFrame) -> DataFrame:
    """Rows of the main list in the form that is served.

    An id of digits is a number and any other null; the description's columns are
    given where there is one, empty rather than null; the lens goes with its score.
    """
    described = F.col("description_summary").isNotNull()
    text = lambda c: F.when(described, F.coalesce(c, F.lit("")))
    return rows.withColumns({
        "id": X.digits_id(F.col("id")),
        "ai_analyzed": described,
        "description_best_perspective": text("description_best_perspective"),
        "description_summary": text("description_summary"),
        "catalog_score_perspective": F.when(F.col("catalog_perspective_score").isNotNull(), F.col("catalog_score_perspective")),
        "is_stack_representative": F.coalesce("is_stack_representative", F.lit(False)),
    })


def page_order(by_score: str | None = None, by_date: str = "desc") -> list[Column]:
    """The order of the main list: by score (nulls last either way), then date, then key; or newest first."""
    date = F.col("date_taken").desc() if by_date == "desc" else F.col("date_taken").asc()
    if by_score:
        return [F.col("lens_score").isNull().asc(), F.desc("lens_score") if by_score == "desc" else F.asc("lens_score"), date, F.asc("key")]
    return [date, F.desc("key")]


def page(rows: DataFrame, limit: int | None = None, offset: int | None = None, by_score: str | None = None, by_date: str = "desc") -> DataFrame:
    """One page in :func:`page_order`; for pages far down see :mod:`shutterlake.operators.rank_index`."""
    limit, offset = X.page_bounds(limit, offset)
    return rows.orderBy(*page_order(by_score, by_date)).offset(offset).limit(limit)


def in_given_order(rows: DataFrame, keys: list) -> DataFrame:
    """The rows of ``keys`` in the caller's order; a key given twice counts at its first place."""
    spark = rows.sparkSession
    places = {k: i for i, k in reversed(list(enumerate(keys)))}
    if not places:
        return rows.limit(0).withColumn("place", F.lit(0))
    wanted = spark.createDataFrame(list(places.items()), f"key {dict(rows.dtypes)['key']}, place int")
    return rows.join(wanted, "key").orderBy("place")


def facet_counts(images: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One row of counts: total, posted, rated, described, with_repetition, with_mood, with_colors."""
    yes = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    a = images.agg(F.count(F.lit(1)).alias("total"), yes(F.col("instagram_posted") == 1).alias("posted"), yes(F.col("rating") >= 1).alias("rated"))
    b = descriptions.agg(F.count(F.lit(1)).alias("described"), yes(F.col("has_repetition") == 1).alias("with_repetition"), yes(X.non_empty_json_list(F.col("mood_tags"))).alias("with_mood"), yes(X.non_empty_json_list(F.col("dominant_colors"))).alias("with_colors"))
    return a.crossJoin(b)


def facets(images: DataFrame, descriptions: DataFrame, scores: DataFrame, tags: int = 40) -> DataFrame:
    """One row of all facets: the counts, and as arrays and structs the colour labels, moods, date range and lenses with a score."""
    labels = color_labels(images).agg(F.array_sort(F.collect_list(F.struct("color_label", "n"))).alias("color_labels"))
    moods = top_tags(descriptions, "mood_tags", tags).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))), lambda m: m["tag"]).alias("top_moods"))
    dates = date_range(images).select(F.coalesce("first", F.lit("")).alias("earliest"), F.coalesce("last", F.lit("")).alias("latest"))
    lenses = scores.agg(F.sort_array(F.collect_set("perspective_slug")).alias("perspectives"))
    return facet_counts(images, descriptions).crossJoin(labels).crossJoin(moods).crossJoin(dates).crossJoin(lenses)


def color_labels(images: DataFrame) -> DataFrame:
    """(color_label, n) of non-empty labels, folded."""
    label = X.ascii_lower(F.col("color_label"))
    return images.where("color_label is not null and trim(color_label) <> ''").groupBy(label.alias("color_label")).agg(F.count(F.lit(1)).alias("n"))


def months(images: DataFrame) -> DataFrame:
    """Distinct months, newest first."""
    return images.select(X.year_month(F.col("date_taken").cast("string")).alias("month")).where("month is not null").distinct().orderBy(F.desc("month"))


def date_range(images: DataFrame) -> DataFrame:
    """(first, last): the first ten characters of the least and largest date."""
    text = F.col("date_taken").cast("string")
    return images.agg(F.substring(F.min(text), 1, 10).alias("first"), F.substring(F.max(text), 1, 10).alias("last"))


def top_tags(rows: DataFrame, column: str, limit: int = 40) -> DataFrame:
    """(tag, n): the most frequent members of a column of JSON arrays, or of arrays, ties by tag."""
    if dict(rows.dtypes)[column] == "string":
        rows = rows.where(X.non_empty_json_list(F.col(column))).select(X.json_strings(F.col(column)).alias(column))
    tags = rows.select(F.explode(column).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def rating_histogram(images: DataFrame) -> DataFrame:
    """(rating, n), null as a group of its own."""
    return images.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def undescribed(images: DataFrame, descriptions: DataFrame, months_back: int | None = None, as_of: str | None = None, year: str | None = None) -> DataFrame:
    """Images with no description, undated first, then newest; within a window of months, or else a year."""
    left = images.join(descriptions.select("key"), "key", "left_anti")
    if months_back:
        left = left.where(since(months_back, as_of))
    elif year:
        left = left.where(X.year(F.col("date_taken").cast("string")) == year)
    return left.orderBy(F.col("date_taken").isNull().desc(), F.desc("date_taken"), F.desc("key"))


def descriptions_page(images: DataFrame, descriptions: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Images with their descriptions: described first, newest description first."""
    limit, offset = X.page_bounds(limit, offset)
    rows = images.join(descriptions, "key", "left")
    return rows.orderBy(F.col("described_at").isNull().asc(), F.desc("described_at"), F.desc("date_taken"), F.asc("key")).offset(offset).limit(limit)


def search_by_keyword(images: DataFrame, texts: DataFrame | TextIndex, keyword: str) -> DataFrame:
    """Images whose text columns hold the keyword, or whose description does as a word; one character skips the latter."""
    fields = [c for c in ("keywords", "filename", "title", "description") if c in images.columns]
    hit = reduce(lambda a, b: a | b, [F.coalesce(X.like_substring(F.col(c), keyword), F.lit(False)) for c in fields], F.lit(False))
    if len(keyword.strip()) < 2:
        return images.where(hit).dropDuplicates(["key"])
    terms = X.search_terms(keyword)
    if not terms:
        return images.where(hit).dropDuplicates(["key"])
    found = full_text(texts, terms).select("key").distinct().withColumn("__text", F.lit(True))
    return images.join(found, "key", "left").where(hit | F.col("__text").isNotNull()).drop("__text").dropDuplicates(["key"])


def sample_keys(images: DataFrame, n: int = 25, seed: int = 0) -> DataFrame:
    """A random sample of keys, the same for a seed however the table is split."""
    return images.select("key").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")))).limit(n)


def usable_path(path: str = "filepath") -> Column:
    """Whether there is a path that is not blank."""
    return F.col(path).isNotNull() & (F.trim(path) != "")


def needs_embedding(images: DataFrame, embeddings: DataFrame, force: bool = False, months_back: int | None = None, as_of: str | None = None) -> DataFrame:
    """Keys with a usable path and no vector, newest first, within a window of months where one is given."""
    left = images.where(usable_path())
    if months_back:
        left = left.where(since(months_back, as_of))
    return newest_first(left if force else left.join(embeddings.select("key"), "key", "left_anti")).select("key")


def since(months_back: int, as_of: str | None = None) -> Column:
    """Dates of the last months before a day, compared as text."""
    day = X.months_before(F.to_date(F.lit(as_of)) if as_of else F.current_date(), months_back)
    return F.col("date_taken").cast("string") >= day.cast("string")


#: What the cache says of a file that is too large to compress.
OVERSIZED = "__oversized__"


def cache_state(images: DataFrame, cache: DataFrame, files: DataFrame, oversized: str = OVERSIZED) -> DataFrame:
    """(key, state): whether the cached copy of an image may be used, from the cache table and the files that exist (path, mtime).

    valid, or why not: missing (no row), video, raw_uncompressed (a raw file that
    stands for itself or was too large), no_copy (the copy's path is empty or its
    file is gone), stale (the original changed or is gone). A file that is too
    large and not raw is valid while it is unchanged.
    """
    originals = files.select(F.col("path").alias("filepath"), F.col("mtime").alias("now"))
    copies = files.select(F.col("path").alias("compressed_path")).distinct().withColumn("__copy", F.lit(True))
    rows = images.select("key", "filepath").join(cache.withColumn("__row", F.lit(True)), "key", "left").join(originals, "filepath", "left").join(copies, "compressed_path", "left")
    path, copy = F.col("filepath"), F.coalesce("compressed_path", F.lit(""))
    unchanged = F.coalesce(F.col("now") == F.col("original_mtime"), F.lit(False))
    state = (
        F.when(F.col("__row").isNull(), "missing")
        .when(X.has_ending(path, X.VIDEO_ENDINGS), "video")
        .when(X.has_ending(path, X.RAW_ENDINGS) & ((copy == path) | (copy == oversized)), "raw_uncompressed")
        .when((copy != oversized) & ((copy == "") | F.col("__copy").isNull()), "no_copy")
        .when(unchanged, "valid")
        .otherwise("stale")
    )
    return rows.select("key", state.alias("state"))


def needs_cache(images: DataFrame, cache: DataFrame, files: DataFrame) -> DataFrame:
    """Images to compress: those whose path is no video's and whose cached copy is not valid, newest first."""
    todo = cache_state(images, cache, files).where(~F.col("state").isin("valid", "video")).select("key")
    return newest_first(images.where(usable_path()).where(X.not_video(F.col("filepath"))).join(todo, "key", "left_semi"))


def skip_histogram(reasons: DataFrame, buckets: tuple[str, ...] = ("no_row", "empty_path", "unresolved", "encode_failed")) -> DataFrame:
    """(reason, n) over fixed buckets, zero included."""
    counts = reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    fixed = reasons.sparkSession.createDataFrame([(b,) for b in buckets], "reason string")
    return fixed.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def latest_of(rows: DataFrame, group: str, order: str, tie: str) -> DataFrame:
    """The newest row of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(order), F.desc(tie))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def image_detail(images: DataFrame, stacks: DataFrame, best: DataFrame, descriptions: DataFrame, key) -> DataFrame:
    """One image with its stack, best score and description."""
    one = images.where(F.col("key") == key).drop("stack_id")
    scored = best.select(F.col("image_key").alias("key"), F.col("score").alias("best_score"), F.col("perspective_slug").alias("best_lens"))
    out = one.join(stacks.select("key", "stack_id", "representative_key", "stack_size"), "key", "left").join(scored, "key", "left")
    return out.join(descriptions, "key", "left")


def enriched(images: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images whose hash was missing with what was found (key, phash, exif, description), and one row of processed, skipped, errors.

    A row of ``found`` without a hash is an error and changes nothing; images that
    have a hash are skipped.
    """
    new = found.select("key", *[F.col(c).alias(f"__{c}") for c in ("phash", "exif", "description")]).dropDuplicates(["key"])
    both = images.join(new, "key", "left")
    todo = F.col("phash").isNull()
    take = todo & F.col("__phash").isNotNull()
    out = both.withColumns({c: F.when(take, F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in ("phash", "exif", "description")})
    counts = both.agg(F.count_if(take).alias("processed"), F.count_if(~todo).alias("skipped"), F.count_if(todo & F.col("__phash").isNull()).alias("errors"))
    return out.select(*images.columns), counts


def decoded(rows: DataFrame, arrays: tuple[str, ...] = (), objects: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """Rows with JSON columns as arrays and maps of text (null where they are malformed), and 0/1 columns as booleans."""
    columns = {c: F.from_json(c, "array<string>") for c in arrays} | {c: F.from_json(c, "map<string,string>") for c in objects} | {c: F.col(c) == 1 for c in flags}
    return rows.withColumns(columns)


def groups_page(groups: DataFrame, candidates: DataFrame, images: DataFrame, hidden: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Similarity groups, newest first, with their candidates' images; groups whose seed is hidden drop out.

    ``groups`` is (group_id, seed_key, created_at), ``candidates`` (group_id, candidate_key, similarity, rank).
    """
    limit, offset = X.page_bounds(limit, offset)
    shown = groups.join(hidden.select(F.col("key").alias("seed_key")), "seed_key", "left_anti")
    chosen = shown.orderBy(F.desc("created_at"), F.desc("group_id")).offset(offset).limit(limit)
    members = candidates.join(images.select(F.col("key").alias("candidate_key"), "rating"), "candidate_key")
    return chosen.join(members, "group_id").orderBy(F.desc("created_at"), F.desc("group_id"), "rank")


def cache_stats(images: DataFrame, cache: DataFrame, files: DataFrame) -> DataFrame:
    """(total, cached, missing, bytes): images, those with a cache row, the rest, and the size of the cached files that exist."""
    total = images.agg(F.countDistinct("key").alias("total"))
    rows = cache.select("key", F.col("compressed_path").alias("path")).join(files, "path", "left")
    have = rows.agg(F.countDistinct("key").alias("cached"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return total.crossJoin(have).select("total", "cached", (F.col("total") - F.col("cached")).alias("missing"), "bytes")


def classify_paths(wanted: DataFrame, images: DataFrame, cache: DataFrame, files: DataFrame) -> DataFrame:
    """(key, state): cached, no_row, empty_path, unresolved where no file is at the path, else readable."""
    rows = wanted.select("key").join(images.select("key", "filepath").withColumn("__row", F.lit(True)), "key", "left")
    rows = rows.join(cache.select("key").distinct().withColumn("__cached", F.lit(True)), "key", "left")
    rows = rows.join(files.select(F.col("path").alias("filepath")).distinct().withColumn("__file", F.lit(True)), "filepath", "left")
    empty = F.col("filepath").isNull() | (F.trim("filepath") == "")
    state = F.when(F.col("__cached"), "cached").when(F.col("__row").isNull(), "no_row").when(empty, "empty_path").when(F.col("__file").isNull(), "unresolved").otherwise("readable")
    return rows.select("key", state.alias("state"))
