"""Filters, lookups, bundles and job lists over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from shutterlake.functions import scalars as X
from shutterlake.operators import catalog as C
from shutterlake.operators import identity as I
from shutterlake.operators import jobs as J
from shutterlake.operators import scores as S
from shutterlake.operators import stacks as K
from shutterlake.operators import sync as Y
from shutterlake.operators import vectors as V
from shutterlake.plans.base import ALL, query, sql_round
from shutterlake.plans.core import _SIGNATURE, _STRENGTH, _VOTES, _pairs
from shutterlake.sources import driver as D

# --- filters -----------------------------------------------------------------

#: Each filter alone: what is asked for, and the same in SQL over the rows that a stack shows.
_FILTERS = {
    "nothing": ({}, "TRUE"),
    "posted": ({"posted": True}, "posted = 1"),
    "unposted": ({"posted": False}, "posted = 0"),
    "month": ({"month": "199603"}, "strftime(date_taken, '%Y%m') = '199603'"),
    "odd_month": ({"month": "1996-03"}, "TRUE"),
    "keyword": ({"keyword": " hig_ "}, "lower(title) LIKE '%hig_%' OR lower(filename) LIKE '%hig_%' OR coalesce(lower(keywords) LIKE '%hig_%', FALSE)"),
    "keyword_in_name": ({"keyword": "G_12"}, "lower(filename) LIKE '%g_12%'"),
    "keyword_in_list": ({"keyword": "sky\""}, "coalesce(keywords LIKE '%Sky\"%', FALSE)"),
    "rating": ({"min_rating": 3}, "rating >= 3"),
    "dates": ({"date_from": "1995-02-01", "date_to": "1996-02-29"}, "date_taken >= TIMESTAMP '1995-02-01' AND date_taken <= TIMESTAMP '1996-02-29'"),
    "color": ({"color_label": " GREEN "}, "lower(color_label) = 'green'"),
    "analyzed": ({"analyzed": True}, "described"),
    "not_analyzed": ({"analyzed": False}, "NOT described"),
    "score": ({"perspective": 2, "min_score": 7}, "lens_score >= 7"),
    "stacks": ({"burst_stack": True}, "stack_size > 1"),
    "no_stacks": ({"burst_stack": False}, "stack_size <= 1"),
    "colors": ({"dominant_colors": ["red", " green ", ""]}, "coalesce(dominant_colors LIKE '[%' AND (dominant_colors LIKE '%\"red\"%' OR dominant_colors LIKE '%\"green\"%'), FALSE)"),
    "no_colors_asked": ({"dominant_colors": [" "]}, "TRUE"),
    "moods": ({"mood_tags": ["dark"]}, "coalesce(mood_tags LIKE '%\"dark\"%', FALSE)"),
    "repetition": ({"has_repetition": True}, "coalesce(has_repetition, 0) = 1"),
    "no_repetition": ({"has_repetition": False}, "coalesce(has_repetition, 0) = 0"),
    "keys": ({"restrict_to_keys": [3, 7, 12, 99, 100]}, "key IN (3, 7, 12, 99, 100)"),
    "no_keys": ({"restrict_to_keys": []}, "FALSE"),
}
_BASE = """, base AS (
  SELECT i.key, i.date_taken, i.rating, i.color_label, i.posted, i.title, 'IMG_' || i.key || '.jpg' AS filename, CASE WHEN i.key % 3 = 0 THEN '["Sky", "sea"]' END AS keywords, r.stack_size, s.score AS lens_score,
         t.key IS NOT NULL AS described, t.dominant_colors, t.mood_tags, t.has_repetition
  FROM images i JOIN reps r ON r.stack_id = i.stack_id AND r.representative_key = i.key LEFT JOIN texts t ON t.key = i.key LEFT JOIN scores s ON s.image_key = i.key AND s.slug = 2)"""


def _named(images):
    n = F.col("key")
    return images.withColumns({"filename": F.concat(F.lit("IMG_"), n.cast("string"), F.lit(".jpg")), "keywords": F.when(n % 3 == 0, '["Sky", "sea"]'), "description": F.lit(None).cast("string")})


def _full_base(spark, d):
    images = _named(D.images(spark, d)).drop("stack_id")
    return C.catalog_base(images, D.stack_fields(spark, d), D.described(spark, d), D.scores(spark, d), 2)


@query(ALL.rstrip() + _BASE + " SELECT " + ", ".join(f"count_if({sql})::BIGINT AS n_{name}, coalesce(sum(key) FILTER (WHERE {sql}), 0)::BIGINT AS k_{name}" for name, (_, sql) in _FILTERS.items()) + " FROM base")
def each_filter(spark, d):
    """How many images every filter lets through, and the sum of their keys."""
    counts = []
    for name, (asked, _) in _FILTERS.items():
        passes = F.coalesce(reduce(lambda a, b: a & b, C.predicates(C.CatalogFilter(**asked))), F.lit(False))
        counts += [F.count_if(passes).alias(f"n_{name}"), F.coalesce(F.sum(F.when(passes, F.col("key"))), F.lit(0)).alias(f"k_{name}")]
    return _full_base(spark, d).agg(*counts)


@query(ALL + "SELECT key, date_taken FROM images WHERE key NOT IN (SELECT key FROM texts) AND strftime(date_taken, '%Y') = '1996'")
def undescribed_in_year(spark, d):
    """Images of a year without a description."""
    return C.undescribed(D.images(spark, d), D.described(spark, d), year="1996").select("key", "date_taken")


_KEYWORD_HITS = """(lower(title) LIKE '%urgent%' OR key IN (SELECT key FROM texts WHERE list_has_any(regexp_extract_all(strip_accents(lower(summary)), '[\\p{L}\\p{N}]+'), ['urgent', 'urgents'])))"""


@query(ALL + f"SELECT DISTINCT key, rating FROM images WHERE {_KEYWORD_HITS}")
def search_by_keyword(spark, d):
    """Images whose title holds a keyword, or whose description has it as a word."""
    return C.search_by_keyword(D.images(spark, d), D.text_index(spark, d), "urgent").select("key", "rating")


@query(ALL + "SELECT 'keyword' AS way, count(*) AS n FROM images WHERE " + _KEYWORD_HITS + " UNION ALL SELECT 'rating', count(*) FROM images WHERE rating >= 4 UNION ALL SELECT 'color', count(*) FROM images WHERE lower(color_label) = 'red' UNION ALL SELECT 'dates', count(*) FROM images WHERE date_taken >= TIMESTAMP '1996-01-01' AND date_taken < TIMESTAMP '1996-06-30 00:00:01' UNION ALL SELECT 'nothing', 0")
def search_ways(spark, d):
    """The ways of the one-of-several search; what comes first in order counts."""
    images, texts = D.images(spark, d), D.text_index(spark, d)
    asked = {"keyword": {"keyword": "urgent", "rating": 4}, "rating": {"rating": 4, "color": "red"}, "color": {"color": "RED", "date_from": "1996"}, "dates": {"date_from": "1996-01-01", "date_to": "1996-06-30 00:00:00"}, "nothing": {}}
    rows = [C.search_dispatch(images, texts, **a).agg(F.count(F.lit(1)).alias("n")).select(F.lit(way).alias("way"), "n") for way, a in asked.items()]
    return reduce(lambda a, b: a.union(b), rows)


@query(ALL.rstrip() + _BASE + " SELECT key, (397 - key) // 7 AS place FROM base WHERE key % 7 = 5 AND key < 400 AND rating >= 1 ORDER BY place")
def filter_in_order(spark, d):
    """Given keys that pass a filter, in the caller's order."""
    f = C.CatalogFilter(min_rating=1)
    return C.filter_in_order(_full_base(spark, d), [*range(397, 0, -7), 397], f).select("key", "place")


@query(ALL + "SELECT key FROM images WHERE key % 6 = 1")
def missing_hashes(spark, d):
    """Images without a hash."""
    return C.missing_hashes(D.images(spark, d).withColumn("phash", F.when(F.col("key") % 6 != 1, F.hex("key"))))


@query(ALL + "SELECT key FROM images JOIN texts USING (key) WHERE dominant_colors IS NULL")
def missing_visual_tags(spark, d):
    """Described images whose description has no colour list."""
    return C.missing_visual_tags(D.images(spark, d), D.described(spark, d))


@query(ALL + "SELECT key FROM images WHERE key % 5 <> 0 AND key NOT IN (SELECT vec_id FROM embeddings) AND date_taken >= TIMESTAMP '1998-03-03' ORDER BY date_taken DESC, key DESC")
def needs_embedding(spark, d):
    """Images of the last month with a path and without a vector, newest first."""
    images = D.images(spark, d).withColumn("filepath", F.when(F.col("key") % 5 == 0, "  ").otherwise("/p"))
    return C.needs_embedding(images, D.vectors(spark, d), months_back=1, as_of="1998-03-31")


_CACHE = """files AS (SELECT key, CASE key % 6 WHEN 0 THEN '/p/' || key || '.mov' WHEN 1 THEN '/p/' || key || '.NEF' ELSE '/p/' || key || '.jpg' END AS path FROM images),
cached AS (SELECT key, path, CASE WHEN key % 10 = 1 THEN path WHEN key % 10 = 2 THEN '__oversized__' WHEN key % 10 = 3 THEN '' WHEN key % 10 = 4 THEN '/gone/' || key ELSE '/c/' || key END AS copy, key % 7 = 0 AS changed, key % 8 = 0 AS lost FROM files WHERE key % 9 <> 0),
states AS (SELECT f.key, f.path, CASE WHEN c.key IS NULL THEN 'missing' WHEN f.path LIKE '%.mov' THEN 'video' WHEN f.path LIKE '%.NEF' AND (copy = f.path OR copy = '__oversized__') THEN 'raw_uncompressed'
  WHEN copy <> '__oversized__' AND (copy = '' OR copy LIKE '/gone/%' OR (copy = f.path AND lost)) THEN 'no_copy' WHEN NOT changed AND NOT lost THEN 'valid' ELSE 'stale' END AS state FROM files f LEFT JOIN cached c USING (key))"""


def _cache(spark, d):
    n = F.col("key")
    path = F.concat(F.lit("/p/"), n.cast("string"), F.when(n % 6 == 0, ".mov").when(n % 6 == 1, ".NEF").otherwise(".jpg"))
    images = D.images(spark, d).withColumn("filepath", path)
    copy = F.when(n % 10 == 1, path).when(n % 10 == 2, C.OVERSIZED).when(n % 10 == 3, "").when(n % 10 == 4, F.concat(F.lit("/gone/"), n.cast("string"))).otherwise(F.concat(F.lit("/c/"), n.cast("string")))
    cache = images.where(n % 9 != 0).select("key", copy.alias("compressed_path"), F.lit(1.0).alias("original_mtime"))
    originals = images.where(n % 8 != 0).select(path.alias("path"), F.when(n % 7 == 0, 2.0).otherwise(1.0).alias("mtime"))
    copies = images.select(F.concat(F.lit("/c/"), n.cast("string")).alias("path"), F.lit(5.0).alias("mtime"))
    return images, cache, originals.union(copies)


@query(ALL.rstrip() + ", " + _CACHE + " SELECT key, state FROM states")
def cache_states(spark, d):
    """Whether the cached copy of every image may be used, or why not."""
    return C.cache_state(*_cache(spark, d))


@query(ALL.rstrip() + ", " + _CACHE + " SELECT key FROM states WHERE state NOT IN ('valid', 'video') AND path NOT LIKE '%.mov'")
def needs_cache(spark, d):
    """Images to compress anew."""
    return C.needs_cache(*_cache(spark, d)).select("key")


# --- lists and bundles ---------------------------------------------------------


@query(ALL + "SELECT i.key, t.model_used, t.described_at FROM images i LEFT JOIN texts t USING (key) ORDER BY t.described_at IS NULL, t.described_at DESC, i.date_taken DESC, i.key LIMIT 40 OFFSET 20")
def descriptions_page(spark, d):
    """The second page of images with their descriptions, the newest description first."""
    return C.descriptions_page(D.images(spark, d), D.described(spark, d), 40, 20).select("key", "model_used", "described_at")


@query(ALL + "SELECT key, date_taken FROM images ORDER BY date_taken DESC, key DESC LIMIT 30")
def newest_images(spark, d):
    """The newest images."""
    return C.newest_first(D.images(spark, d)).limit(30).select("key", "date_taken")


@query(ALL + "SELECT key, date_taken FROM images WHERE key IN (SELECT vec_id FROM embeddings) ORDER BY date_taken DESC, key DESC")
def embedded_newest(spark, d):
    """The images that have vectors, newest first."""
    return V.embedded_newest_first(D.images(spark, d), D.vectors(spark, d))


@query(ALL + "SELECT key FROM images ORDER BY md5('7:' || key) LIMIT 25")
def sample_keys(spark, d):
    """A random sample of keys."""
    return C.sample_keys(D.images(spark, d), 25, 7)


@query(ALL.rstrip() + _BASE + """ SELECT CASE WHEN key % 4 = 0 THEN NULL ELSE key END AS id, described AS ai_analyzed, CASE WHEN described THEN coalesce(model_used, '') END AS description_best_perspective,
  lens_score AS catalog_perspective_score, CASE WHEN lens_score IS NOT NULL THEN 'two' END AS catalog_score_perspective, TRUE AS is_stack_representative FROM base LEFT JOIN (SELECT key, model_used FROM texts) q USING (key)""")
def api_rows(spark, d):
    """Rows of the main list as they are served."""
    rows = C.search(_full_base(spark, d), C.CatalogFilter())
    given = rows.select(F.when(F.col("key") % 4 == 0, F.concat(F.lit("x"), F.col("key").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("key").cast("string"))).alias("id"), F.col("summary").alias("description_summary"), F.col("model_used").alias("description_best_perspective"), F.col("lens_score").alias("catalog_perspective_score"), F.lit("two").alias("catalog_score_perspective"), (F.col("key") == F.col("representative_key")).alias("is_stack_representative"))
    return C.api_rows(given).drop("description_summary")


@query("SELECT doc_id AS key, CASE d.doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 4 THEN 2 END AS colors, toxic = 1 AS has_repetition, 'm' || (doc_id % 3) AS model FROM documents d LEFT JOIN labels USING (doc_id)")
def decoded_rows(spark, d):
    """Descriptions with their JSON decoded."""
    rows = D.described(spark, d).withColumn("meta", F.concat(F.lit('{"model":"'), F.col("model_used"), F.lit('"}')))
    out = C.decoded(rows, arrays=("dominant_colors",), objects=("meta",), flags=("has_repetition",))
    return out.select("key", F.when(F.col("dominant_colors").isNotNull(), F.size("dominant_colors")).alias("colors"), "has_repetition", F.col("meta")["model"].alias("model"))


@query(ALL.rstrip() + f""", rounded AS (SELECT image_key, slug, score, {sql_round('pct', 6)} AS pct FROM pct)
SELECT image_key, max(pct) AS peak, count(*) AS coverage, count(*) >= 2 AS eligible, string_agg(slug || '=Lens ' || slug || '=' || score, ',' ORDER BY slug) AS lenses FROM rounded GROUP BY image_key""")
def peak_details(spark, d):
    """Peak percentiles with all lenses of each image."""
    rows = S.peak_details(D.population(spark, d), D.perspectives(spark, d), 2)
    text = F.transform("per_perspective", lambda p: F.concat_ws("=", p["perspective_slug"].cast("string"), p["display_name"], p["score"].cast("string")))
    return rows.select("image_key", "peak", "coverage", "eligible", F.array_join(text, ",").alias("lenses"))


@query(ALL + "SELECT '1,2,3,4' AS active_perspectives, (SELECT count(*) FROM images) AS total_catalog_images, count(*) AS scored_any_count, count_if(n >= 2)::BIGINT AS eligible_count FROM (SELECT count(*) AS n FROM pct GROUP BY image_key) q")
def peak_meta(spark, d):
    """What goes with the peaks."""
    rows = S.peak_meta(S.peaks(D.population(spark, d), 2), D.images(spark, d), D.perspectives(spark, d))
    return rows.withColumn("active_perspectives", F.array_join(F.col("active_perspectives").cast("array<string>"), ","))


_PENDING = """, best AS (SELECT image_key, max(score) AS score FROM scores GROUP BY image_key), blank AS (SELECT image_key AS key FROM best WHERE score < 4.5),
pending AS (SELECT a.key FROM images a JOIN images b ON b.key = a.key + 1 WHERE a.key % 5 <> 0 AND a.key NOT IN (SELECT key FROM blank) AND b.key NOT IN (SELECT key FROM blank)
  AND NOT (a.stack_id = b.stack_id AND (SELECT count(*) FROM images c WHERE c.stack_id = a.stack_id) > 1))"""


def _suggested(spark, d):
    pairs = _pairs(spark, d)
    rejected = pairs.where("seed_key % 5 = 0").select(F.col("seed_key").alias("key_a"), F.col("candidate_key").alias("key_b"))
    images = D.images(spark, d).withColumn("date_taken", F.col("date_taken").cast("timestamp"))
    return pairs, images, D.stack_fields(spark, d).where("stack_size > 1"), rejected, K.blank_keys(S.best_score(D.scores(spark, d)))


@query(ALL.rstrip() + _PENDING + " SELECT count(*) AS pending FROM pending")
def count_pending(spark, d):
    """How many suggestions are to be decided."""
    return K.count_pending(*_suggested(spark, d))


@query(ALL.rstrip() + _PENDING + """ SELECT (SELECT count(*) FROM images) AS catalog_images, (SELECT count(DISTINCT image_key) FROM scores JOIN lenses USING (slug) WHERE active = 1 AND score >= 9) AS scoring_9_plus,
 (SELECT count(*) FROM reps WHERE stack_size > 1) AS burst_stacks, (SELECT count(*) FROM pending) AS pending_stack_suggestions,
 (SELECT count(*) FROM images i WHERE (SELECT count(DISTINCT slug) FROM scores s JOIN lenses USING (slug) WHERE active = 1 AND s.image_key = i.key) < (SELECT count(*) FROM lenses WHERE active = 1)) AS unscored_on_active_perspectives,
 (SELECT count(*) FROM images WHERE key NOT IN (SELECT image_key FROM scores)) AS no_current_score,
 (SELECT string_agg(slug || ':' || display_name || ':' || active || ':' || n, ',' ORDER BY slug) FROM (SELECT p.slug, p.display_name, p.active, count(DISTINCT s.image_key) AS n FROM lenses p LEFT JOIN scores s USING (slug) GROUP BY ALL) q) AS perspective_coverage""")
def insights_summary(spark, d):
    """The counts of the landing page in one row; the coverage list as text."""
    images, fields = D.images(spark, d), D.stack_fields(spark, d)
    stacks = fields.where("stack_size > 1").select("stack_id").distinct()
    rows = I.insights(images, D.scores(spark, d), D.perspectives(spark, d), stacks, K.pending_suggestions(*_suggested(spark, d)))
    text = F.transform("perspective_coverage", lambda p: F.concat_ws(":", p["slug"].cast("string"), p["display_name"], p["active"].cast("string"), p["images"].cast("string")))
    return rows.withColumn("perspective_coverage", F.array_join(text, ","))


@query(
    ALL.rstrip() + ",\n" + _VOTES + ",\n" + _SIGNATURE
    + f""", shown AS (SELECT slug, count(*) AS n FROM pct WHERE image_key NOT IN (SELECT key FROM hidden) GROUP BY slug),
pure AS (SELECT a.slug, a.image_key, a.pct, coalesce({sql_round('(a.pct - (SELECT max(b.pct) FROM pct b WHERE b.image_key = a.image_key AND b.slug <> a.slug)) * 100', 1)}, 0.0) AS purity FROM pct a),
firsts AS (SELECT slug, string_agg(CAST(image_key AS VARCHAR), ',' ORDER BY place) AS exemplars FROM (
  SELECT slug, image_key, row_number() OVER (PARTITION BY slug ORDER BY pct DESC, purity DESC, image_key) AS place FROM pure WHERE image_key NOT IN (SELECT key FROM hidden)) q WHERE place <= 24 GROUP BY slug)
SELECT perspective_slug, display_name, votes, z, crowned, section, {_STRENGTH}, coalesce(n, 0) AS exemplar_total, CASE WHEN section IS NOT NULL THEN exemplars END AS exemplars, section IS NOT NULL AS has_words
FROM mirror JOIN lenses ON lenses.slug = perspective_slug LEFT JOIN shown ON shown.slug = perspective_slug LEFT JOIN firsts ON firsts.slug = perspective_slug"""
)
def mirror(spark, d):
    """The mirror of all lenses: signature, section, exemplars; keys of exemplars as text."""
    pct = D.population(spark, d)
    texts = S.attempted(D.scores(spark, d), D.perspectives(spark, d)).join(D.table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_name"), "partkey")
    tokens = texts.select("perspective_slug", F.explode(X.rationale_tokens(F.col("p_name"))).alias("token"))
    rows = I.mirror(pct, K.hidden_members(D.stack_fields(spark, d)), D.catalog_total(spark, d), D.perspectives(spark, d), tokens)
    keys = F.array_join(F.transform("exemplars", lambda e: e["image_key"].cast("string")), ",")
    return rows.select("perspective_slug", "display_name", "votes", "z", "crowned", "section", "strength", "exemplar_total", keys.alias("exemplars"), (F.size("descriptors") > 0).alias("has_words")).withColumn("has_words", F.coalesce("has_words", F.lit(False)))


@query(
    ALL
    + f"""SELECT perspective_slug, place, image_key FROM (
  SELECT slug AS perspective_slug, image_key, row_number() OVER (PARTITION BY slug ORDER BY pct DESC, purity DESC, image_key) AS place FROM (
    SELECT a.slug, a.image_key, a.pct, coalesce({sql_round('(a.pct - (SELECT max(b.pct) FROM pct b WHERE b.image_key = a.image_key AND b.slug <> a.slug)) * 100', 1)}, 0.0) AS purity FROM pct a) q
  WHERE image_key NOT IN (SELECT key FROM hidden)) r WHERE place BETWEEN 25 AND 36"""
)
def exemplars_page(spark, d):
    """A later page of each lens's images."""
    return I.exemplars(D.population(spark, d), K.hidden_members(D.stack_fields(spark, d)), 12, 24).select("perspective_slug", "place", "image_key")


@query(ALL + "SELECT DISTINCT slug AS perspective_slug FROM scores")
def distinct_slugs(spark, d):
    """Lenses with a score."""
    return S.distinct_slugs(D.scores(spark, d))


@query("SELECT l_orderkey AS image_key, l_linenumber AS perspective_slug, l_shipdate AS scored_at, l_partkey AS id FROM lineitem WHERE l_orderkey % 50 = 1")
def score_history(spark, d):
    """All scores of some images over time."""
    rows = D.table(spark, d, "lineitem").where("l_orderkey % 50 = 1").select(F.col("l_orderkey").alias("image_key"), F.col("l_linenumber").alias("perspective_slug"), F.col("l_shipdate").alias("scored_at"), F.col("l_partkey").alias("id"))
    return S.history(rows)


@query("SELECT slug, scored_at, id FROM (SELECT l_linenumber AS slug, l_shipdate AS scored_at, l_partkey * 100000 + l_suppkey AS id, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_shipdate DESC, l_partkey * 100000 + l_suppkey DESC) AS n FROM lineitem) q WHERE n = 1")
def latest_of_lens(spark, d):
    """The newest score of each lens."""
    rows = D.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("slug"), F.col("l_shipdate").alias("scored_at"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id"))
    return C.latest_of(rows, "slug", "scored_at", "id")


@query(ALL + "SELECT image_key, score, slug AS perspective_slug FROM scores WHERE image_key NOT IN (SELECT key FROM hidden) AND image_key IN (SELECT key FROM images) AND slug = 1")
def primary_scores(spark, d):
    """Scores of images that a grid shows."""
    shown = D.images(spark, d).select(F.col("key").alias("image_key")).join(K.hidden_members(D.stack_fields(spark, d)).select(F.col("key").alias("image_key")), "image_key", "left_anti")
    return D.scores(spark, d).where("perspective_slug = 1").join(shown, "image_key", "left_semi").select("image_key", "score", "perspective_slug")


@query(ALL + "SELECT stack_id, representative_key, coalesce(stack_size, 0) AS stack_size, coalesce(members, '') AS members FROM (SELECT stack_id, representative_key FROM reps) r LEFT JOIN (SELECT stack_id, count(*) AS stack_size, string_agg(CAST(key AS VARCHAR), ',' ORDER BY key) AS members FROM images WHERE key % 10 <> 0 GROUP BY stack_id) m USING (stack_id)")
def stack_metadata(spark, d):
    """Stacks with the members they still have."""
    rows = D.images(spark, d).where("key % 10 <> 0").select("stack_id", "key")
    chosen = D.stack_fields(spark, d).select("stack_id", "representative_key").distinct()
    found = K.metadata(chosen, rows)
    return found.withColumn("members", F.coalesce(F.array_join(F.col("members").cast("array<string>"), ","), F.lit("")))


@query("SELECT o_orderkey AS key FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7)")
def stack_of_image(spark, d):
    """The members of the stack that an image is in."""
    return K.containing(D.images(spark, d).select("stack_id", "key"), 7)


@query("""WITH f AS (SELECT event_id, ts FROM events WHERE event_id % 4 <> 0),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 90000000 THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS seg FROM g)
SELECT min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS members FROM s GROUP BY seg HAVING count(*) >= 2""")
def incremental_bursts(spark, d):
    """Bursts of the events that are in no stack yet."""
    rows = D.logs(spark, d).select("ts", F.col("id").alias("key"))
    return K.incremental_bursts(rows, rows.where("key % 4 = 0").select("key"), "ts", "key", 90_000).select("start_ts", "end_ts", "members")


# --- work lists ----------------------------------------------------------------


@query(ALL + """SELECT i.key AS image_key, p.slug AS perspective_slug FROM images i CROSS JOIN (SELECT slug FROM lenses WHERE active = 1) p
WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.image_key = i.key AND s.slug = p.slug AND s.partkey % 3 = 1) AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.image_key = i.key AND s.slug = p.slug AND s.partkey % 5 = 2)
AND NOT (i.key % 20 = 0 AND p.slug = 1)""")
def work_triples_left(spark, d):
    """Scores to give, less those of the present prompt, those of the model, and those of a checkpoint."""
    rows = D.scores(spark, d).withColumns({"prompt_version": F.concat(F.lit("v"), (F.col("partkey") % 3).cast("string")), "model_used": F.concat(F.lit("m"), (F.col("partkey") % 5).cast("string")), "is_current": F.lit(1)})
    versions = D.perspectives(spark, d).select(F.col("slug").alias("perspective_slug"), F.lit("v1").alias("prompt_version"))
    checkpoint = D.images(spark, d).where("key % 20 = 0").select(F.col("key").alias("image_key"), F.lit(1).alias("perspective_slug"))
    return S.work_triples(D.images(spark, d), D.perspectives(spark, d), [S.current_for_version(rows, versions), S.done_by_model(rows, "m2"), checkpoint])


@query(ALL + "SELECT key, date_taken FROM images WHERE key NOT IN (SELECT key FROM texts WHERE model_used = 'm1')")
def undescribed_by_model(spark, d):
    """Images that a model has not described."""
    return C.undescribed(D.images(spark, d), S.done_by_model(D.described(spark, d), "m1")).select("key", "date_taken")


# --- jobs ----------------------------------------------------------------------

_JOBS = "jobs AS (SELECT event_id AS id, event_type, user_id, ts AS created_at, props, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'cancelled' ELSE 'completed' END AS status FROM events)"


def _jobs(spark, d):
    n = F.col("id") % 5
    status = F.when(n == 0, "pending").when(n == 1, "running").when(n == 2, "failed").when(n == 3, "cancelled").otherwise("completed")
    return D.logs(spark, d).withColumnRenamed("ts", "created_at").withColumn("status", status)


@query("WITH " + _JOBS + " SELECT id, status IN ('pending', 'running') AS can_cancel, status IN ('failed', 'cancelled') AS can_retry FROM jobs")
def job_actions(spark, d):
    """What can be done with every job."""
    return _jobs(spark, d).select("id", J.can_cancel(F.col("status")).alias("can_cancel"), J.can_retry(F.col("status")).alias("can_retry"))


@query("WITH " + _JOBS + " SELECT id, created_at FROM jobs WHERE status IN ('pending', 'running')")
def active_jobs(spark, d):
    """Jobs that wait or run."""
    return J.active(_jobs(spark, d)).select("id", "created_at")


@query("WITH " + _JOBS + " SELECT j.id, l.total, l.warnings FROM (SELECT id FROM jobs WHERE id < 200) j LEFT JOIN (SELECT user_id AS id, count(*) AS total, count_if(event_type = 'warning')::BIGINT AS warnings FROM events GROUP BY user_id) l USING (id)")
def jobs_with_stats(spark, d):
    """Jobs with the counts of their logs."""
    return J.with_stats(_jobs(spark, d).where("id < 200").select("id", "created_at"), D.logs(spark, d)).select("id", "total", "warnings")


@query("SELECT event_id AS id, user_id AS job_id FROM events WHERE event_id % 2 = 0 OR user_id % 3 = 0")
def appended_logs(spark, d):
    """Logs after new rows, of which those of unknown jobs are left out."""
    logs = D.logs(spark, d)
    jobs = logs.where("job_id % 3 = 0").select(F.col("job_id").alias("id")).distinct()
    return J.append_logs(logs.where("id % 2 = 0"), logs.where("id % 2 = 1"), jobs).select("id", "job_id")


@query("WITH " + _JOBS + """, kinds AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'catalog_sync' WHEN 1 THEN 'batch_embed_image' WHEN 2 THEN 'batch_stack_detect' ELSE 'other' END AS type, CASE WHEN id % 3 = 0 THEN 'instagram' WHEN id % 3 = 1 THEN 'catalog' END AS image_type FROM (SELECT *, id AS event_id FROM jobs) q),
mine AS (SELECT CASE WHEN type = 'catalog_sync' THEN 'catalog_sync' WHEN type = 'batch_embed_image' AND coalesce(image_type, 'catalog') = 'catalog' THEN 'embed_catalog' WHEN type = 'batch_stack_detect' THEN 'stack_detect' END AS bucket, * FROM kinds)
SELECT v.bucket, id AS job_id, type, status FROM (VALUES ('catalog_sync'), ('embed_catalog'), ('stack_detect'), ('catalog_similarity'), ('catalog_cache_build')) v(bucket)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY created_at DESC, id DESC) AS n FROM mine WHERE bucket IS NOT NULL) m ON m.bucket = v.bucket AND n = 1""")
def pipeline_status(spark, d):
    """The newest job of each fixed bucket, the empty ones included."""
    n = F.col("id")
    kind = F.when(n % 4 == 0, "catalog_sync").when(n % 4 == 1, "batch_embed_image").when(n % 4 == 2, "batch_stack_detect").otherwise("other")
    meta = F.when(n % 3 == 0, '{"image_type":"instagram"}').when(n % 3 == 1, '{"image_type":"catalog"}').otherwise("{}")
    return J.pipeline_status(_jobs(spark, d).withColumns({"type": kind, "metadata": meta})).select("bucket", "job_id", "type", "status")


@query("WITH " + _JOBS + " SELECT id, CASE WHEN status = 'running' THEN CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'failed' END ELSE status END AS status FROM jobs")
def recovered_jobs(spark, d):
    """Jobs after a restart."""
    return J.recovered(_jobs(spark, d).withColumn("metadata", F.when(F.col("id") % 3 == 0, '{"checkpoint_version": 1}').otherwise("{}"))).select("id", "status")


# --- source catalog --------------------------------------------------------------


def _source(spark, d):
    """The driver's geography as a source catalog: regions are roots, nations folders, customers files, and orders images."""
    roots = D.table(spark, d, "region").select(F.col("r_regionkey").alias("id_local"), F.concat(F.lit("/"), F.col("r_name"), F.lit("/")).alias("absolutePath"))
    folders = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("id_local"), F.concat(F.col("n_name"), F.lit("/")).alias("pathFromRoot"), F.col("n_regionkey").alias("rootFolder"))
    n = F.col("c_custkey")
    files = D.table(spark, d, "customer").select(n.alias("id_local"), F.concat(F.lit("F"), n.cast("string")).alias("baseName"), F.when(n % 4 == 0, "").when(n % 4 == 1, "jpg").when(n % 4 == 2, "dng").alias("extension"), F.col("c_nationkey").alias("folder"))
    images = files.where("id_local % 3 <> 0").select((F.col("id_local") + 100000).alias("id_local"), F.col("id_local").alias("rootFile"), (F.col("id_local") % 6).alias("rating"), F.lit(0).alias("pick"), F.lit("Red").alias("colorLabels"), F.lit(1).alias("fileWidth"), F.lit(2).alias("fileHeight"), F.lit("2020-01-01T00:00:00").alias("captureTime"))
    exif = images.where("id_local % 2 = 0").select(F.col("id_local").alias("image"), (F.col("id_local") % 100 / 10).alias("aperture"))
    iptc = images.where("id_local % 5 = 0").select(F.col("id_local").alias("image"), F.lit("caption").alias("caption"))
    return files, folders, roots, images, exif, iptc


_SOURCE = "src AS (SELECT c_custkey AS file_id, '/' || r_name || '/' || n_name || '/F' || c_custkey || CASE c_custkey % 4 WHEN 1 THEN '.jpg' WHEN 2 THEN '.dng' ELSE '' END AS filepath, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey + 100000 END AS image FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query("WITH " + _SOURCE + " SELECT file_id, filepath, image, CASE WHEN image IS NOT NULL THEN file_id % 6 END AS rating, CASE WHEN image % 2 = 0 THEN image % 100 / 10 END AS aperture, CASE WHEN image % 5 = 0 THEN 'caption' END AS caption FROM src")
def source_catalog(spark, d):
    """Every file of a source catalog with its path and metadata."""
    return Y.catalog_metadata(*_source(spark, d)).select("file_id", "filepath", "image", "rating", "aperture", "caption")


@query("WITH " + _SOURCE + " SELECT file_id, filepath FROM src ORDER BY file_id LIMIT 20")
def source_first(spark, d):
    """The first files of a source catalog."""
    return Y.catalog_metadata(*_source(spark, d)).orderBy("file_id").limit(20).select("file_id", "filepath")


@query("SELECT image, string_agg(name, ',' ORDER BY name) AS keywords FROM (SELECT l_orderkey AS image, 'K' || l_linenumber AS name FROM lineitem WHERE l_linenumber <> 3) q GROUP BY image")
def source_keywords(spark, d):
    """Keywords of every image; links to an unknown name do not count."""
    links = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("tag"))
    names = links.select(F.col("tag").alias("id_local")).distinct().where("id_local <> 3").withColumn("name", F.concat(F.lit("K"), F.col("id_local").cast("string")))
    return Y.keywords(links, names).withColumn("keywords", F.array_join("keywords", ","))


@query("SELECT c_custkey AS image, 7 AS tag, c_custkey + 100000 AS right_image FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def wrong_keyword_links(spark, d):
    """Links that name files where they should name images."""
    files, images = _source(spark, d)[0], _source(spark, d)[3]
    # a file's id may be another image's, but a link tells them apart: files get even ids, images odd ones
    files = files.select((F.col("id_local") * 2).alias("id_local"))
    images = images.select((F.col("id_local") * 2 + 1).alias("id_local"), (F.col("rootFile") * 2).alias("rootFile"))
    links = files.where("id_local % 4 = 0").union(images.select("id_local")).select(F.col("id_local").alias("image"), F.lit(7).cast("long").alias("tag"))
    names = spark.range(7, 8).select(F.col("id").alias("id_local"), F.lit("k").alias("name"))
    found = Y.wrong_keyword_links(links, names, images)
    return found.select(F.shiftright("image", 1).alias("image"), "tag", F.shiftright("right_image", 1).alias("right_image"))


@query("SELECT model_id, provider_id FROM (SELECT DISTINCT 'S' || s_nationkey AS model_id, 'p' AS provider_id FROM supplier UNION SELECT DISTINCT 'S' || c_nationkey, 'p' FROM customer) q")
def provider_models(spark, d):
    """Models of the registry and those found, once each."""
    a = D.table(spark, d, "supplier").select(F.lit("p").alias("provider_id"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("model_id")).distinct()
    b = D.table(spark, d, "customer").select(F.lit("p").alias("provider_id"), F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("model_id"))
    return Y.provider_models(a, b, ["S7", "S3"])
