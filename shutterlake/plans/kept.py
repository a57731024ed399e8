"""Queries over tables that are kept and changed: buckets, indexes, counts, logs of work, catalog files."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import scalars as X
from shutterlake.operators import catalog as C
from shutterlake.operators import kept as P
from shutterlake.operators import rank_index as G
from shutterlake.operators import resume as R
from shutterlake.operators import scores as S
from shutterlake.operators import sync as Y
from shutterlake.operators import text_index as T
from shutterlake.plans.base import ALL, query
from shutterlake.sources import catalog_files as L
from shutterlake.sources import driver as D
from shutterlake.sources import work
from shutterlake.sources.buckets import BucketTable
from shutterlake.streaming import bursts as B


def _bucketed(df, name, *keys):
    return BucketTable.create(df, work.new_path(df.sparkSession, name), keys, 32)


@query(ALL + "SELECT key, CASE WHEN key % 501 = 3 THEN 9 ELSE rating END AS rating, CASE WHEN key % 503 = 5 THEN 1 ELSE posted END AS instagram_posted FROM images WHERE key % 499 <> 7 UNION ALL SELECT -key, 2, 0 FROM images WHERE key % 505 = 9")
def table_images(spark, d):
    """Images in buckets after a few were upserted (known and new ones), marked as posted, and deleted."""
    rows = D.images(spark, d).select("key", "rating", "instagram_posted", F.lit("1").alias("analyzed_at"))
    table = _bucketed(rows, "images", "key")
    n = F.col("key")
    known = rows.where(n % 501 == 3).withColumns({"rating": F.lit(9), "instagram_posted": F.lit(5), "analyzed_at": F.lit("2")})
    fresh = rows.where(n % 505 == 9).select((-n).alias("key"), F.lit(2).alias("rating"), F.lit(0).alias("instagram_posted"), F.lit("2").alias("analyzed_at"))
    table.change(known.union(fresh), Y.upsert_images)
    table.change(rows.where(n % 503 == 5).select("key", F.lit(1).alias("instagram_posted")), lambda old, new: Y.set_values(old, new, "instagram_posted"))
    table.change(rows.where(n % 499 == 7).select("key"), Y.delete_keys)
    return table.read().select("key", "rating", "instagram_posted")


@query("SELECT vec_id AS key, CASE WHEN vec_id % 97 = 5 THEN 2 ELSE 1 END AS scale, embedding[1] * CASE WHEN vec_id % 97 = 5 THEN 2 ELSE 1 END AS first FROM embeddings")
def table_vectors(spark, d):
    """Vectors in buckets after a few were replaced."""
    rows = D.vectors(spark, d).select("key", "embedding").withColumn("scale", F.lit(1))
    table = _bucketed(rows, "vectors", "key")
    table.change(rows.where("key % 97 = 5").withColumns({"embedding": F.transform("embedding", lambda x: x * F.lit(2).cast("float")), "scale": F.lit(2)}), lambda old, new: Y.replace_rows(old, new, "key"))
    return table.read().select("key", "scale", F.col("embedding")[0].alias("first"))


@query("""WITH base AS (SELECT l_orderkey AS image_key, l_linenumber AS slug, min(l_shipdate) AS scored_at FROM lineitem GROUP BY ALL),
now AS (SELECT image_key, slug, 'v2' AS version, 1 AS is_current FROM base WHERE image_key % 333 = 1 AND slug < 3)
SELECT image_key, slug AS perspective_slug, 'v1' AS prompt_version, CASE WHEN image_key % 333 = 1 AND slug < 3 THEN 0 ELSE 1 END AS is_current FROM base WHERE NOT (image_key % 501 = 2)
UNION ALL SELECT * FROM now""")
def table_scores(spark, d):
    """Scores in buckets of the image after a few were superseded, and one version of others deleted."""
    base = D.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image_key"), F.col("l_linenumber").alias("perspective_slug")).agg(F.min("l_shipdate").cast("string").alias("scored_at"))
    rows = base.select("image_key", F.lit("catalog").alias("image_type"), "perspective_slug", F.lit("v1").alias("prompt_version"), "scored_at", F.lit(1).cast("long").alias("is_current"), (F.col("image_key") * 10 + F.col("perspective_slug")).alias("id"))
    table = _bucketed(rows, "scores", "image_key")
    new = rows.where("image_key % 333 = 1 and perspective_slug < 3").withColumns({"prompt_version": F.lit("v2"), "id": -F.col("id")})
    table.change(new, S.supersede)
    gone = rows.where("image_key % 501 = 2").select("image_key", "image_type", "perspective_slug", "prompt_version")
    table.change(gone, S.delete_version)
    return table.read().select("image_key", "perspective_slug", "prompt_version", F.col("is_current").cast("int").alias("is_current"))


_WORDS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"


@query(f"""WITH w AS (SELECT doc_id AS key, {_WORDS} AS words FROM documents WHERE text IS NOT NULL AND doc_id % 50 NOT IN (3, 4))
SELECT key FROM w WHERE list_has_any(words, ['of', 'ofs']) AND list_has_any(words, ['the', 'thes']) AND list_has_any(words, ['thing', 'things', 'thinged', 'thinges', 'thinging'])
UNION ALL SELECT doc_id FROM documents WHERE doc_id % 50 = 3""")
def fts_after_upsert(spark, d):
    """A search through the index of stored stems, after a few descriptions were written anew, some with the words and some without."""
    n = F.col("image_key")
    rows = D.table(spark, d, "documents").select(F.col("doc_id").alias("image_key"), F.col("text").alias("summary"), *[F.lit(None).cast("string").alias(c) for c in ("subjects", "dominant_colors", "mood_tags", "perspectives", "best_perspective")], F.lit(None).cast("long").alias("has_repetition"), F.lit("1").alias("described_at"))
    table = Y.create_descriptions(rows, work.new_path(spark, "descriptions"), 32)
    index = T.build_from_tokens(table.read().select(n.alias("key"), "tokens"))
    new = rows.where(n % 50 == 3).withColumn("summary", F.lit("Things óf the sea")).union(rows.where(n % 50 == 4).withColumn("summary", F.lit("nothing")))
    Y.upsert_descriptions_indexed(table, index, new.withColumn("described_at", F.lit("2")), vacuum=True)
    table.drop()  # only the index is read from here on
    return C.full_text(index, X.search_terms("of the things") or [])


_CHANGED = """, now AS (
  SELECT key, CASE WHEN key % 10 = 3 THEN TIMESTAMP '2001-02-03' ELSE date_taken END AS date_taken, CASE WHEN key % 10 = 3 THEN 0 ELSE rating END AS rating,
         CASE WHEN key % 10 = 3 THEN ' Blue ' ELSE color_label END AS color_label, CASE WHEN key % 10 = 3 THEN 1 ELSE posted END AS posted FROM images WHERE key % 11 <> 4),
told AS (SELECT key, dominant_colors, CASE WHEN key % 13 = 1 THEN '["wild"]' ELSE mood_tags END AS mood_tags, has_repetition FROM texts),
left_scores AS (SELECT * FROM scores WHERE slug <> 7)"""


@query(ALL.rstrip() + _CHANGED + """
SELECT (SELECT count(*) FROM now) AS total, (SELECT count(*) FROM now WHERE posted = 1) AS posted, (SELECT count(*) FROM now WHERE rating >= 1) AS rated, count(*) AS described, count_if(has_repetition = 1)::BIGINT AS with_repetition,
       count_if(mood_tags NOT IN ('[]', 'null', ''))::BIGINT AS with_mood, count_if(dominant_colors NOT IN ('[]', 'null', ''))::BIGINT AS with_colors,
       (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT lower(color_label) || ':' || count(*) AS c FROM now WHERE trim(color_label) <> '' GROUP BY lower(color_label)) q) AS color_labels,
       (SELECT string_agg(tag, ',' ORDER BY n DESC, tag) FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(CAST(m AS VARCHAR[])) AS tag FROM (SELECT replace(mood_tags, '"', '') AS m FROM told WHERE mood_tags LIKE '[%')) r GROUP BY tag) q) AS top_moods,
       (SELECT strftime(min(date_taken), '%Y-%m-%d') FROM now) AS earliest, (SELECT strftime(max(date_taken), '%Y-%m-%d') FROM now) AS latest,
       (SELECT string_agg(CAST(slug AS VARCHAR), ',' ORDER BY slug) FROM (SELECT DISTINCT slug FROM left_scores) q) AS perspectives FROM told""")
def facets_kept(spark, d):
    """All facets from kept counts, after images were upserted and deleted, descriptions written anew, and a lens's scores deleted."""
    images, texts, scores = D.images(spark, d), D.described(spark, d), D.scores(spark, d)
    kept = work.written(P.counted(P.of_images(images).unionByName(P.of_descriptions(texts)).unionByName(P.of_scores(scores))), "facets")
    n = F.col("key")
    old = images.where((n % 10 == 3) | (n % 11 == 4))
    new = images.where((n % 10 == 3) & (n % 11 != 4)).withColumns({"date_taken": F.lit("2001-02-03").cast(dict(images.dtypes)["date_taken"]), "rating": F.lit(0), "color_label": F.lit(" Blue "), "instagram_posted": F.lit(1)})
    kept = P.changed(kept, P.of_images(old), P.of_images(new))
    told = texts.where("key % 13 = 1")
    kept = P.changed(kept, P.of_descriptions(told), P.of_descriptions(told.withColumn("mood_tags", F.lit('["wild"]'))))
    gone = P.of_scores(scores.where("perspective_slug = 7"))
    rows = P.facets(P.changed(kept, gone, gone.limit(0)))
    labels = F.transform("color_labels", lambda x: F.concat(x["color_label"], F.lit(":"), x["n"].cast("string")))
    return rows.withColumns({"color_labels": F.array_join(labels, ","), "top_moods": F.array_join("top_moods", ","), "perspectives": F.array_join("perspectives", ",")})


@query(ALL + "SELECT key, date_taken, rating, (SELECT count(*) FROM images WHERE rating >= 2) AS total FROM images WHERE rating >= 2 ORDER BY date_taken DESC, key DESC LIMIT 40 OFFSET 700")
def deep_page(spark, d):
    """A page far down the main list with its total, from the ranges that hold it."""
    index = G.build(D.images(spark, d).where("rating >= 2").select("key", "date_taken", "rating"), C.page_order, size=256)
    return index.page(40, 700).withColumn("total", F.lit(index.total()).cast("long"))


@query(ALL + "SELECT key, rating * 2 AS doubled FROM images")
def resumed_work(spark, d):
    """Images worked on in buckets, stopped after some of them, and gone on with."""
    todo, folder = D.images(spark, d).select("key", "rating"), work.new_path(spark, "resumed")
    step = lambda rows: rows.select("key", (F.col("rating") * 2).alias("doubled"))
    R.in_buckets(todo, step, folder, {"model": "m"}, buckets=6, most=4)
    return R.in_buckets(todo, step, folder, {"model": "m"}, buckets=6)


@query("SELECT o_orderkey AS id_local, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey BETWEEN 300 AND 900 AND o_totalprice > 50000 AND o_orderstatus <> 'P'")
def catalog_files(spark, d):
    """Orders written as catalog files, and some of them read back with the comparisons pushed down."""
    rows = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id_local"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("status"), "o_comment" if "o_comment" in D.table(spark, d, "orders").columns else F.lit("").alias("o_comment"))
    folder = work.new_path(spark, "catalogs").removeprefix("file:")
    L.write(rows, folder, "images", "id_local")
    found = L.read(spark, folder, "images", rows=512, schema="id_local long, price double, status string")
    return found.where("id_local between 300 and 900 and price > 50000 and status <> 'P'")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, arg_min(event_id, (ts, event_id)) AS start_key, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS members, arg_max(event_id, (value, ts, event_id)) AS representative
FROM s GROUP BY user_id, seg HAVING count(*) >= 2""")
def stream_bursts(spark, d):
    """Bursts of each user's events four hours apart at most, from a stream in which events come in no order."""
    folder = work.new_path(spark, "stream")
    rows = D.logs(spark, d).select("id", "job_id", "ts", "value")
    rows.repartition(6, "id").write.parquet(f"{folder}/in")
    stream = B.burst_stream(B.follow(spark, f"{folder}/in", rows.schema, 2), "ts", "id", "job_id", "value", 14_400_000, "60 days")
    found = B.standing(B.run_once(stream, folder)).where(F.size("members") >= 2)
    return found.select(F.col("group").alias("user_id"), "start_us", "end_us", "start_key", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "representative")
