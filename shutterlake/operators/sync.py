"""Sync with the source catalog, and upserts: functions from the old table and the new rows to the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators.text_index import TextIndex
from shutterlake.sources.buckets import BucketTable
from shutterlake.sources.work import discard, written


def numeric_ids(rows: DataFrame, column: str) -> DataFrame:
    """Distinct numeric ids; other text is skipped."""
    return rows.select(F.expr(f"try_cast(trim(cast(`{column}` AS string)) AS bigint)").alias("id")).where("id is not null").distinct()


def missing(source: DataFrame, library: DataFrame, column: str = "id") -> DataFrame:
    """Ids of the source that the library lacks."""
    return numeric_ids(source, column).join(numeric_ids(library, column), "id", "left_anti")


def stale(source: DataFrame, library: DataFrame, column: str = "id") -> DataFrame:
    """Ids of the library that the source lacks."""
    return numeric_ids(library, column).join(numeric_ids(source, column), "id", "left_anti")


def newest(new: DataFrame, key: str, order: str, *aside: str) -> DataFrame:
    """The newest row of each key; all columns but those ``aside`` order what is equally new."""
    last = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(c) for c in sorted(new.columns) if c not in (key, order, *aside)])
    return new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, keep_old: tuple[str, ...] = (), fill_from_old: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the newest of ``new`` replaces the old.

    Columns in ``keep_old`` stay as they were where there was a row; those in
    ``fill_from_old`` stay where the new value is null.
    """
    o, n = old.alias("o"), newest(new, key, order).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new = F.col(f"n.{key}").isNotNull()

    def pick(c: str):
        if c in keep_old:
            return F.when(F.col(f"o.{key}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        if c in fill_from_old:
            return F.coalesce(f"n.{c}", f"o.{c}")
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[pick(c).alias(c) for c in old.columns])


def upsert_images(old: DataFrame, new: DataFrame, order: str = "analyzed_at") -> DataFrame:
    """Images by key; whether one was posted survives."""
    return upsert(old, new, "key", order, keep_old=("instagram_posted",))


def upsert_catalog_images(old: DataFrame, new: DataFrame, order: str = "analyzed_at") -> DataFrame:
    """Images by key, where an unknown hash, EXIF, path or description does not erase a known one."""
    return upsert(old, new, "key", order, keep_old=("instagram_posted",), fill_from_old=("phash", "exif", "catalog_path", "description"))


def delete_keys(old: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The table without some keys."""
    return old.join(keys.select(key), key, "left_anti")


def set_values(old: DataFrame, changes: DataFrame, column: str, key: str = "key") -> DataFrame:
    """The table with ``column`` from (key, column) where it is given there."""
    new = changes.groupBy(key).agg(F.max(column).alias("__new"))
    return old.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).select(*old.columns)


def sync_counts(source: DataFrame, library: DataFrame) -> DataFrame:
    """(missing, stale, in_both)."""
    a, b = numeric_ids(source, "id").withColumn("s", F.lit(1)), numeric_ids(library, "id").withColumn("l", F.lit(1))
    return a.join(b, "id", "full_outer").agg(F.count_if(F.col("l").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("stale"), F.count_if(F.col("s").isNotNull() & F.col("l").isNotNull()).alias("in_both"))


def applied(source: DataFrame, library: DataFrame, records: DataFrame, order: str = "analyzed_at") -> tuple[DataFrame, DataFrame]:
    """The library after a sync, and its counts: rows of missing ids are upserted, none is deleted.

    ``source`` holds the catalog's ids, ``records`` the rows of the catalog in the
    library's columns, of which only the missing ones are taken.
    """
    lacking = missing(source, library)
    new = records.join(lacking.withColumnRenamed("id", "__id"), F.trim(F.col("id").cast("string")).try_cast("bigint") == F.col("__id"), "left_semi")
    after = upsert(library, new.select(*library.columns), "key", order, keep_old=("instagram_posted",))
    counts = sync_counts(source, library).withColumnRenamed("missing", "missing_ids_count").drop("in_both")
    totals = numeric_ids(source, "id").agg(F.count(F.lit(1)).alias("catalog_total")).crossJoin(numeric_ids(library, "id").agg(F.count(F.lit(1)).alias("library_total")))
    return after, totals.crossJoin(counts).crossJoin(new.agg(F.countDistinct("key").alias("added")))


def upsert_descriptions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Descriptions by image, with the text that is searched and its stems kept beside them.

    Colour and mood lists that are neither arrays nor objects are null, the
    repetition flag is 1, 0 or null, and the legacy columns ``perspectives`` and
    ``best_perspective`` stay as they were.
    """
    from shutterlake.functions.udfs import porter_tokens

    before = old if "tokens" in old.columns else old.withColumn("tokens", porter_tokens("description_search_document"))
    return upsert(before, described(new), "image_key", "described_at", keep_old=("perspectives", "best_perspective"))


def described(new: DataFrame) -> DataFrame:
    """Descriptions in the form they are kept in (see :func:`upsert_descriptions`), row by row."""
    from shutterlake.functions import scalars as X
    from shutterlake.functions.udfs import porter_tokens

    clean = new.withColumns({
        "dominant_colors": X.json_list_or_map(F.col("dominant_colors")),
        "mood_tags": X.json_list_or_map(F.col("mood_tags")),
        "has_repetition": X.repetition_flag(F.col("has_repetition")).cast("long"),
        "description_search_document": X.search_document(F.col("summary"), F.col("subjects")),
    })
    return clean.withColumn("tokens", porter_tokens("description_search_document"))


def create_descriptions(new: DataFrame, folder: str, buckets: int = 64) -> BucketTable:
    """A table in buckets of ``image_key`` of what :func:`upsert_descriptions` makes of ``new`` where there were none.

    Rows are dealt out as they came in, once; searched texts and stems are added after
    that. Only rows of keys that repeat are put in order. Keys are not null.
    """
    repeated = written(new.groupBy("image_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("image_key"), "repeated")
    rows = new
    if not repeated.isEmpty():
        several = new.join(repeated, "image_key", "left_semi")
        last = newest(described(several.withColumn("__row", F.struct(*new.columns))), "image_key", "described_at", "__row")
        rows = new.join(repeated, "image_key", "left_anti").unionByName(last.select("__row.*"))
    table = BucketTable.create(rows, folder, ["image_key"], buckets, described)
    discard(repeated)
    return table


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table where the rows of the new keys are deleted and the new ones inserted, as vectors and cache rows are."""
    return delete_keys(old, new, key).unionByName(new)


def catalog_metadata(files: DataFrame, folders: DataFrame, roots: DataFrame, images: DataFrame, exif: DataFrame, iptc: DataFrame) -> DataFrame:
    """One row a file of the source catalog, with its path, image, EXIF and caption; order and limit it by file_id."""
    f = files.select(F.col("id_local").alias("file_id"), F.col("baseName").alias("base"), "extension", "folder")
    d = folders.select(F.col("id_local").alias("folder"), "pathFromRoot", "rootFolder")
    r = roots.select(F.col("id_local").alias("rootFolder"), "absolutePath")
    i = images.select(F.col("id_local").alias("image"), F.col("rootFile").alias("file_id"), "rating", "pick", F.col("colorLabels").alias("color_label"), F.col("fileWidth").alias("width"), F.col("fileHeight").alias("height"), F.col("captureTime").alias("date_taken"))
    path = F.concat("absolutePath", "pathFromRoot", "base", F.when(F.coalesce("extension", F.lit("")) != "", F.concat(F.lit("."), F.col("extension"))).otherwise(F.lit("")))
    return f.join(d, "folder").join(r, "rootFolder").join(i, "file_id", "left").join(exif, "image", "left").join(iptc, "image", "left").withColumn("filepath", path)


def keywords(links: DataFrame, names: DataFrame) -> DataFrame:
    """(image, keywords) from link and name tables."""
    named = links.join(names.select(F.col("id_local").alias("tag"), "name"), "tag")
    return named.groupBy("image").agg(F.sort_array(F.collect_list("name")).alias("keywords"))


def keyword_write_back(wanted: DataFrame, source: DataFrame, links: DataFrame, tag: int) -> DataFrame:
    """(key, outcome): added, skipped, or error for keys the source does not know.

    ``source`` is (image, base); a key's base name is what follows its date.
    """
    base = F.regexp_replace(F.regexp_replace("key", r"^[^_]*_", ""), r"\.[^.]*$", "")
    found = wanted.select("key", base.alias("base")).join(source, "base", "left")
    have = links.where(F.col("tag") == tag).select("image").distinct().withColumn("have", F.lit(True))
    outcome = F.when(F.col("image").isNull(), "error").when(F.col("have"), "skipped").otherwise("added")
    return found.join(have, "image", "left").select("key", outcome.alias("outcome"))


def unify_keys(images: DataFrame, new_key: str, columns: list[str]) -> DataFrame:
    """One row for each new key: the one with the most filled columns, ties to the least old key."""
    filled = sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in columns), F.lit(0))
    best = Window.partitionBy(new_key).orderBy(F.desc("__filled"), F.asc("key"))
    rows = images.withColumn("__filled", filled).withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return rows.drop("__filled", "__n")


def remap(children: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Child rows with keys replaced by (old_key, new_key)."""
    joined = children.join(mapping.select(F.col("old_key").alias(column), "new_key"), column, "left")
    return joined.withColumn(column, F.coalesce("new_key", column)).select(*children.columns)


def merge_models(registry: DataFrame, user: DataFrame) -> DataFrame:
    """Registry models, then the user's that it lacks."""
    keys = ["provider_id", "model_id"]
    return registry.unionByName(user.join(registry.select(*keys), keys, "left_anti").dropDuplicates(keys))


def provider_models(registry: DataFrame, found: DataFrame, order: list[str]) -> DataFrame:
    """A provider's models: those of the registry, then those found, once each; models named in ``order`` come first, in that order."""
    both = merge_models(registry.withColumn("place", F.lit(0)), found.withColumn("place", F.lit(1)))
    wanted = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col("model_id")) if order else F.lit(0)
    return both.orderBy(wanted == 0, wanted, "place", "model_id").drop("place")


def wrong_keyword_links(links: DataFrame, names: DataFrame, images: DataFrame) -> DataFrame:
    """Links that name a file where they should name its image: (image, tag, right_image)."""
    files = images.select(F.col("rootFile").alias("image"), F.col("id_local").alias("right_image"))
    known = names.select(F.col("id_local").alias("tag"))
    right = images.select(F.col("id_local").alias("image"))
    return links.join(known, "tag", "left_semi").join(right, "image", "left_anti").join(files, "image").select("image", "tag", "right_image")


def upsert_perspective(old: DataFrame, new: DataFrame) -> DataFrame:
    """Perspectives by slug; whether one is optional follows from its markdown."""
    from shutterlake.functions.scalars import optional_marker

    marked = new.withColumn("optional", optional_marker(F.col("prompt_markdown")).cast("long"))
    return upsert(old, marked, "slug", "updated_at", keep_old=("id", "created_at"))


def upsert_descriptions_indexed(table: BucketTable, index: TextIndex, new: DataFrame, vacuum: bool = False) -> list[int]:
    """:func:`upsert_descriptions` on a table in buckets of ``image_key``, with its text index; returns the table's buckets written.

    With ``vacuum``, for tables that nobody else reads, what was replaced is deleted at once.
    """
    keys = written(table.keyed(new).select("image_key").distinct(), "keys")
    tokens = lambda: table.lookup(keys).select(F.col("image_key").alias("key"), "tokens")
    before = written(tokens(), "before")
    touched = table.change(new, upsert_descriptions)
    if vacuum:
        table.vacuum()
    index.upsert(before, tokens())
    if vacuum:
        index.postings.vacuum()
        index.counts.vacuum()
    discard(before, keys)
    return touched
