"""Scores, identity, catalog, stacks, vectors, sync and jobs over the driver's tables."""

from __future__ import annotations

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
from shutterlake.sources import driver as D
from shutterlake.sources import work

# --- scores ------------------------------------------------------------------


@query(ALL + "SELECT image_key, score, slug AS perspective_slug FROM (SELECT *, row_number() OVER (PARTITION BY image_key ORDER BY score DESC, slug) AS rn FROM scores) q WHERE rn = 1")
def best_score(spark, d):
    """Best score of every image."""
    return S.best_score(D.scores(spark, d))


@query(ALL + f"SELECT image_key, max({sql_round('pct', 6)}) AS peak, count(*) AS coverage, count(*) >= 1 AS eligible FROM pct GROUP BY image_key")
def peak_percentile(spark, d):
    """Peak percentile of every image."""
    return S.peaks(D.population(spark, d))


@query(ALL + f"SELECT image_key, slug AS perspective_slug, score, {sql_round('pct', 9)} AS pct FROM pct")
def percentiles(spark, d):
    """Midrank percentile of every score."""
    return D.population(spark, d).select("image_key", "perspective_slug", "score", X.exact_round(F.col("pct"), 9).alias("pct"))


@query(
    ALL
    + f"""SELECT image_key, peak, coverage, date_taken, posted AS instagram_posted FROM (
  SELECT image_key, max({sql_round('pct', 6)}) AS peak, count(*) AS coverage FROM pct GROUP BY image_key) p JOIN images i ON i.key = p.image_key
WHERE image_key NOT IN (SELECT key FROM hidden) ORDER BY peak DESC, date_taken DESC, image_key LIMIT 50"""
)
def rank_best_photos(spark, d):
    """First page of the best photos."""
    return S.rank_best_photos(D.population(spark, d), D.images(spark, d), K.hidden_members(D.stack_fields(spark, d)))


@query(ALL + f"SELECT image_key, {sql_round('avg(score)', 4)} AS mean_score, count(*) AS coverage, count(*) >= 2 AS eligible FROM pop GROUP BY image_key")
def image_aggregate(spark, d):
    """Equal-weight mean of every image."""
    return S.aggregate(S.attempted(D.scores(spark, d), D.perspectives(spark, d)), 2).drop("scores")


@query(ALL + "SELECT p.slug, p.display_name, p.active, count(DISTINCT s.image_key) AS images FROM lenses p LEFT JOIN scores s USING (slug) GROUP BY ALL")
def coverage(spark, d):
    """Images scored under each lens."""
    return S.coverage(D.scores(spark, d), D.perspectives(spark, d))


@query(ALL + "SELECT slug, count(*) AS images FROM images i CROSS JOIN (SELECT slug FROM lenses WHERE active = 1) p WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.image_key = i.key AND s.slug = p.slug) GROUP BY slug")
def unscored_active(spark, d):
    """Images without a score under each active lens."""
    return S.unscored_on_active(D.images(spark, d), D.scores(spark, d), D.perspectives(spark, d)).where("images > 0")


@query(ALL + "SELECT DISTINCT i.key FROM images i CROSS JOIN (SELECT slug FROM lenses WHERE active = 1) p WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.image_key = i.key AND s.slug = p.slug)")
def missing_some_active(spark, d):
    """Images that lack some active lens."""
    return S.images_missing_active(D.images(spark, d), D.scores(spark, d), D.perspectives(spark, d))


@query(ALL + "SELECT key FROM images WHERE key NOT IN (SELECT image_key FROM scores)")
def no_current_score(spark, d):
    """Images with no score."""
    return S.without_score(D.images(spark, d), D.scores(spark, d))


@query(ALL + "SELECT count(DISTINCT image_key) AS images FROM scores JOIN lenses USING (slug) WHERE active = 1 AND score >= 9")
def scoring_9_plus(spark, d):
    """Images with a nine or more."""
    return S.scoring_at_least(D.scores(spark, d), D.perspectives(spark, d))


@query(ALL + "SELECT i.key AS image_key, p.slug AS perspective_slug FROM images i CROSS JOIN (SELECT slug FROM lenses WHERE active = 1) p WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.image_key = i.key AND s.slug = p.slug)")
def work_triples(spark, d):
    """Scores still to give."""
    return S.work_triples(D.images(spark, d), D.perspectives(spark, d), [D.scores(spark, d)])


_VERSIONS = """versions AS (
  SELECT l_orderkey AS image_key, l_linenumber AS slug, CAST(l_shipdate AS VARCHAR) AS scored_at, l_partkey * 1000 + l_suppkey AS id, l_returnflag AS prompt_version, l_extendedprice FROM lineitem)"""


@query(
    f"""WITH {_VERSIONS}, sides AS (SELECT *, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS new FROM versions),
kept AS (
  SELECT *, max(new) OVER (PARTITION BY image_key, slug) AS touched FROM (
    SELECT *, row_number() OVER (PARTITION BY image_key, slug, prompt_version ORDER BY new DESC, scored_at DESC, id DESC, l_extendedprice DESC) AS v FROM sides) q WHERE v = 1)
SELECT image_key, slug AS perspective_slug, prompt_version, id,
       CASE WHEN touched = 0 THEN CASE WHEN prompt_version = 'N' THEN 1 ELSE 0 END
            WHEN row_number() OVER (PARTITION BY image_key, slug ORDER BY new DESC, scored_at DESC, id DESC, l_extendedprice DESC) = 1 THEN 1 ELSE 0 END AS is_current FROM kept"""
)
def supersede(spark, d):
    """Score versions after every third came in anew: a new one replaces its version and is the only current one of its image and lens."""
    rows = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_key"), F.lit("catalog").alias("image_type"), F.col("l_linenumber").alias("perspective_slug"), F.col("l_shipdate").cast("string").alias("scored_at"), F.struct((F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("n"), "l_extendedprice").alias("id"), F.col("l_returnflag").alias("prompt_version"), F.when(F.col("l_returnflag") == "N", 1).otherwise(0).cast("long").alias("is_current"))
    new = F.col("id.n") % 3 == 0
    return S.supersede(rows.where(~new), rows.where(new)).select("image_key", "perspective_slug", "prompt_version", F.col("id.n").alias("id"), "is_current")


# --- identity ----------------------------------------------------------------

_VOTES = """seen AS (SELECT *, count(*) OVER (PARTITION BY image_key) AS k, max(pct) OVER (PARTITION BY image_key) AS top FROM pct),
voters AS (SELECT *, sum(CASE WHEN pct = top THEN 1 ELSE 0 END) OVER (PARTITION BY image_key) AS tops FROM seen WHERE k >= 2),
votes AS (SELECT slug AS perspective_slug, CAST(sum(CASE WHEN pct = top AND tops = 1 THEN 1 ELSE 0 END) AS BIGINT) AS votes, count(*) AS photos_on, sum(1.0 / k) AS expected FROM voters GROUP BY slug)"""


@query(ALL.rstrip() + ",\n" + _VOTES + "\nSELECT perspective_slug, votes, photos_on, round(expected, 6) AS expected FROM votes")
def signature_votes(spark, d):
    """Votes of images for their best lens."""
    return I.votes(D.population(spark, d)).withColumn("expected", F.round("expected", 6)).drop("population")


#: The signature in SQL; with 30 images or more the crown is closed-form, since the corrected z must reach the normal's 95th percentile.
_SIGNATURE = f"""n AS (SELECT count(*) AS population FROM (SELECT image_key FROM pct GROUP BY image_key HAVING count(*) >= 2) q),
total AS (SELECT count(*) AS total FROM images),
chances AS (SELECT *, expected / photos_on AS chance, (votes - expected) / sqrt(photos_on * (expected / photos_on) * (1 - expected / photos_on)) AS raw_z,
                   (votes - 0.5 - expected) / sqrt(photos_on * (expected / photos_on) * (1 - expected / photos_on)) AS z_cc FROM votes CROSS JOIN n CROSS JOIN total),
sig AS (SELECT perspective_slug, votes, photos_on, population, {sql_round('expected', 4)} AS expected, {sql_round('raw_z', 2)} AS z, z_cc > 1.6448536269514722 AND raw_z > 0 AS crowned,
               {sql_round('votes / photos_on', 6)} AS win_rate, {sql_round('chance', 6)} AS chance_rate, {sql_round('photos_on / total', 4)} AS coverage, photos_on / total < 0.5 AS low_coverage FROM chances),
placed AS (SELECT *, NOT max(crowned) OVER () AS fallback, row_number() OVER (ORDER BY crowned DESC, CASE WHEN crowned THEN 0 ELSE votes END DESC, z DESC, perspective_slug) AS place FROM sig),
mirror AS (SELECT *, fallback AND place = 1 AS leads, CASE WHEN crowned OR (fallback AND place = 1) THEN place END AS section FROM placed)"""
_STRENGTH = "CASE WHEN leads THEN 'Leading, but not strongly distinctive' WHEN z >= 6 THEN 'A defining strength' WHEN z >= 3 THEN 'A clear strength' WHEN crowned THEN 'A strength' ELSE 'Leading, but not strongly distinctive' END AS strength"


@query(ALL.rstrip() + ",\n" + _VOTES + ",\n" + _SIGNATURE + f"\nSELECT perspective_slug, votes, photos_on, population, expected, z, crowned, win_rate, chance_rate, coverage, low_coverage, fallback, section, leads, {_STRENGTH} FROM mirror")
def signature_stats(spark, d):
    """The full signature of every lens (without the tail probability, for which DuckDB has no error function)."""
    return I.sections(I.signature(D.population(spark, d), D.catalog_total(spark, d))).drop("p_value")


@query(
    ALL
    + f"""SELECT perspective_slug, place, image_key, {sql_round('pct', 6)} AS pct, purity FROM (
  SELECT slug AS perspective_slug, image_key, pct, purity, row_number() OVER (PARTITION BY slug ORDER BY pct DESC, purity DESC, image_key) AS place FROM (
    SELECT a.slug, a.image_key, a.pct, coalesce({sql_round('(a.pct - (SELECT max(b.pct) FROM pct b WHERE b.image_key = a.image_key AND b.slug <> a.slug)) * 100', 1)}, 0.0) AS purity FROM pct a) q
  WHERE image_key NOT IN (SELECT key FROM hidden)) r WHERE place <= 12"""
)
def purity_exemplars(spark, d):
    """The first images of each lens."""
    return I.exemplars(D.population(spark, d), K.hidden_members(D.stack_fields(spark, d)))


@query(
    ALL.rstrip()
    + """, tokens AS (SELECT slug, unnest(string_split(lower(p_name), ' ')) AS token FROM pop JOIN part ON p_partkey = partkey),
own AS (SELECT slug, token, count(*) AS n FROM tokens WHERE length(token) >= 3 AND token NOT IN (SELECT unnest(string_split('"""
    + " ".join(X.STOP_WORDS)
    + """', ' '))) GROUP BY slug, token),
rows AS (
  SELECT slug AS perspective_slug, token, n, ln((n / sum(n) OVER (PARTITION BY slug)) / (sum(n) OVER (PARTITION BY token) / sum(n) OVER ())) AS raw FROM own)
SELECT perspective_slug, token, n, round(raw, 4) AS log_odds FROM (SELECT *, row_number() OVER (PARTITION BY perspective_slug ORDER BY round(raw, 9) DESC, n DESC, token) AS place FROM rows WHERE n >= 5) q WHERE place <= 15"""
)
def descriptors(spark, d):
    """Words that mark each lens."""
    pop = S.attempted(D.scores(spark, d), D.perspectives(spark, d))
    texts = pop.join(D.table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_name"), "partkey")
    return I.descriptors(texts.select("perspective_slug", F.explode(X.rationale_tokens(F.col("p_name"))).alias("token"))).drop("place")


@query(
    ALL.rstrip()
    + ",\n"
    + _VOTES
    + ",\n"
    + _SIGNATURE
    + f""", rounded AS (SELECT image_key, slug, {sql_round('pct', 6)} AS pct FROM pct),
peak AS (SELECT image_key, max(pct) AS peak, count(*) AS coverage FROM rounded GROUP BY image_key),
rows AS (SELECT p.*, i.date_taken FROM peak p LEFT JOIN images i ON i.key = p.image_key WHERE coalesce(i.posted, 0) = 0),
cut AS (SELECT list_sort(list(peak))[CAST(round_even(0.9 * (count(*) - 1), 0) AS INT) + 1] AS p90 FROM rows),
lens AS (SELECT image_key, slug AS lens FROM (SELECT *, row_number() OVER (PARTITION BY image_key ORDER BY pct DESC, slug) AS rn FROM rounded) q WHERE rn = 1)
SELECT image_key, peak, coverage, lens, lens IN (SELECT perspective_slug FROM sig WHERE crowned) AS is_signature, peak >= p90 AS top_tenth,
       CASE WHEN peak >= p90 THEN 'high_score_unposted' ELSE 'eligible_unposted' END AS code, date_taken
FROM rows JOIN lens USING (image_key) CROSS JOIN cut ORDER BY peak DESC, date_taken DESC, image_key LIMIT 50"""
)
def suggest_next(spark, d):
    """What to post next, with the codes of the reasons."""
    pct = D.population(spark, d)
    crowned = I.signature(pct, D.catalog_total(spark, d)).where("crowned")
    return I.suggest_next(pct, D.images(spark, d), crowned=crowned).withColumn("codes", F.array_join("codes", ",")).withColumnRenamed("codes", "code")


# --- catalog -----------------------------------------------------------------


def _base(spark, d, f):
    return C.catalog_base(D.images(spark, d).drop("stack_id"), D.stack_fields(spark, d), None, D.scores(spark, d), f.perspective)


_FILTER = C.CatalogFilter(posted=False, min_rating=2, color_label=" RED ", date_from="1995-01-01", date_to="1999-12-31", perspective=2, min_score=4, min_score_on_active=8)
_FOUND = """, found AS (
  SELECT i.*, s.score AS lens_score FROM images i LEFT JOIN scores s ON s.image_key = i.key AND s.slug = 2
  WHERE posted = 0 AND rating >= 2 AND lower(color_label) = 'red' AND date_taken >= TIMESTAMP '1995-01-01' AND date_taken <= TIMESTAMP '1999-12-31' AND s.score >= 4
    AND EXISTS (SELECT 1 FROM scores t JOIN lenses USING (slug) WHERE active = 1 AND t.image_key = i.key AND t.score >= 8) AND i.key NOT IN (SELECT key FROM hidden))"""


@query(ALL.rstrip() + _FOUND + " SELECT key, date_taken, rating, color_label, lens_score FROM found ORDER BY lens_score DESC, date_taken DESC, key LIMIT 50")
def catalog_search(spark, d):
    """A page of a search with many filters, by score."""
    rows = C.search(_base(spark, d, _FILTER), _FILTER, D.scores(spark, d), D.perspectives(spark, d))
    return C.page(rows, by_score="desc").select("key", "date_taken", "rating", "color_label", "lens_score")


@query(ALL.rstrip() + _FOUND + " SELECT count(*) AS total FROM found")
def catalog_count(spark, d):
    """The total of the same search."""
    return C.search(_base(spark, d, _FILTER), _FILTER, D.scores(spark, d), D.perspectives(spark, d)).agg(F.count(F.lit(1)).alias("total"))


@query(ALL + "SELECT key, stack_size FROM images JOIN reps USING (stack_id) WHERE key = representative_key AND stack_size > 1")
def burst_stack_filter(spark, d):
    """Representatives of stacks."""
    f = C.CatalogFilter(burst_stack=True)
    return C.search(_base(spark, d, f), f).select("key", "stack_size")


@query(ALL + "SELECT key, title FROM images WHERE lower(title) LIKE '%urg_nt%'")
def keyword_search(spark, d):
    """Images whose title has a substring with a wildcard."""
    return D.images(spark, d).where(X.like_substring(F.col("title"), "URG_nt")).select("key", "title")


@query(ALL + "SELECT key, rating FROM images WHERE key IN (7, 3, 1, 12)")
def by_keys_in_order(spark, d):
    """Images of given keys."""
    return C.in_given_order(D.images(spark, d), [7, 3, 1, 12, 3]).select("key", "rating")


@query(ALL + "SELECT lower(color_label) AS color_label, count(*) AS n FROM images WHERE trim(color_label) <> '' GROUP BY 1")
def color_labels(spark, d):
    """Images of each colour label."""
    return C.color_labels(D.images(spark, d))


@query(ALL + "SELECT DISTINCT strftime(date_taken, '%Y%m') AS month FROM images ORDER BY month DESC")
def months(spark, d):
    """Months with images."""
    return C.months(D.images(spark, d))


@query(ALL + "SELECT strftime(min(date_taken), '%Y-%m-%d') AS first, strftime(max(date_taken), '%Y-%m-%d') AS last FROM images")
def date_range(spark, d):
    """First and last day."""
    return C.date_range(D.images(spark, d))


@query(ALL + "SELECT rating, count(*) AS n FROM images GROUP BY rating")
def rating_histogram(spark, d):
    """Images of each rating."""
    return C.rating_histogram(D.images(spark, d))


_COUNTS = """(SELECT count(*) FROM images) AS total, (SELECT count(*) FROM images WHERE posted = 1) AS posted, (SELECT count(*) FROM images WHERE rating >= 1) AS rated, count(*) AS described,
       count_if(has_repetition = 1)::BIGINT AS with_repetition, count_if(mood_tags NOT IN ('[]', 'null', ''))::BIGINT AS with_mood, count_if(dominant_colors NOT IN ('[]', 'null', ''))::BIGINT AS with_colors"""


@query(ALL + f"SELECT {_COUNTS} FROM texts")
def facet_counts(spark, d):
    """Global counts."""
    return C.facet_counts(D.images(spark, d), D.described(spark, d))


@query(
    ALL
    + f"""SELECT {_COUNTS}, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT lower(color_label) || ':' || count(*) AS c FROM images WHERE color_label <> '' GROUP BY lower(color_label)) q) AS color_labels,
       (SELECT string_agg(tag, ',' ORDER BY n DESC, tag) FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(CAST(mood_tags AS VARCHAR[])) AS tag FROM (SELECT replace(mood_tags, '"', '') AS mood_tags FROM texts WHERE mood_tags LIKE '[%')) r GROUP BY tag) q) AS top_moods,
       (SELECT strftime(min(date_taken), '%Y-%m-%d') FROM images) AS earliest, (SELECT strftime(max(date_taken), '%Y-%m-%d') FROM images) AS latest,
       (SELECT string_agg(CAST(slug AS VARCHAR), ',' ORDER BY slug) FROM (SELECT DISTINCT slug FROM scores) q) AS perspectives FROM texts"""
)
def catalog_facets(spark, d):
    """All facets in one row; lists as text."""
    rows = C.facets(D.images(spark, d), D.described(spark, d), D.scores(spark, d))
    labels = F.transform("color_labels", lambda x: F.concat(x["color_label"], F.lit(":"), x["n"].cast("string")))
    return rows.withColumns({"color_labels": F.array_join(labels, ","), "top_moods": F.array_join("top_moods", ","), "perspectives": F.array_join(F.col("perspectives").cast("array<string>"), ",")})


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(text, ' '))) AS tag FROM documents) q GROUP BY tag ORDER BY n DESC, tag LIMIT 40")
def top_tags(spark, d):
    """The most frequent members of arrays, here of the distinct words of texts."""
    return C.top_tags(D.table(spark, d, "documents").select(F.array_distinct(F.split("text", " ")).alias("tags")), "tags")


@query("SELECT d.doc_id AS key, has.toxic AS has_repetition FROM documents d LEFT JOIN labels has USING (doc_id) WHERE coalesce(has.toxic, 0) = 0")
def repetition_filter(spark, d):
    """Descriptions without repetition, the unknown included."""
    return D.descriptions(spark, d).where(F.coalesce("has_repetition", F.lit(0)) == 0).select("key", "has_repetition")


@query(ALL + "SELECT key, date_taken FROM images WHERE key NOT IN (SELECT doc_id FROM documents) AND date_taken >= TIMESTAMP '1998-03-03' ORDER BY date_taken DESC, key DESC")
def undescribed(spark, d):
    """Images without a description in the month before 31 March 1998, where a February day runs over."""
    return C.undescribed(D.images(spark, d), D.descriptions(spark, d).select("key"), months_back=1, as_of="1998-03-31").select("key", "date_taken")


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS VARCHAR) IN ('7', '9') OR event_type = 'error'")
def json_any_of(spark, d):
    """Events whose JSON array, made of a property and the type, holds a wanted value."""
    rows = D.logs(spark, d).withColumn("k", F.get_json_object("props", "$.k"))
    return rows.where(X.json_any_of(F.to_json(F.array("k", "level")), ["7", " 9 ", "error", ""])).select("id", "k")


@query("SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY 1")
def json_field_group(spark, d):
    """Events by a JSON property."""
    return D.logs(spark, d).groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT doc_id AS key, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS words FROM documents WHERE text IS NOT NULL)
SELECT key FROM w WHERE list_has_any(words, ['of', 'ofs']) AND list_has_any(words, ['the', 'thes']) AND list_has_any(words, ['thing', 'things', 'thinged', 'thinges', 'thinging'])"""
)
def fts_search(spark, d):
    """Documents with all stems of a query; in SQL, with the words of each stem that occur."""
    return C.full_text(D.text_index(spark, d), X.search_terms("of the things") or []).select("key")


# --- bursts, stacks ----------------------------------------------------------


@query(
    """WITH g AS (SELECT event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 60000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS seg FROM g)
SELECT min(ts) AS start_ts, arg_min(event_id, ts) AS start_key, max(ts) AS end_ts, count(*) AS members FROM s GROUP BY seg HAVING count(*) >= 2"""
)
def bursts(spark, d):
    """Segments of events a minute apart at most, of two or more."""
    return K.segments(D.logs(spark, d).select("ts", "id"), "ts", "id", 60_000).where("members >= 2")


@query(ALL + "SELECT stack_id, representative_key, stack_size FROM reps")
def burst_representative(spark, d):
    """The representative of each stack."""
    return D.stack_fields(spark, d).select("stack_id", "representative_key", "stack_size").distinct()


def _pairs(spark, d):
    """Consecutive images of a customer as suggested pairs."""
    rows = D.images(spark, d)
    return rows.select((F.col("key") % 97).alias("group_id"), F.col("key").alias("seed_key"), (F.col("key") + 1).alias("candidate_key"), (1 - (F.col("key") % 100) / 1000).alias("similarity"))


@query(
    ALL.rstrip()
    + """, best AS (SELECT image_key, max(score) AS score FROM scores GROUP BY image_key), blank AS (SELECT image_key AS key FROM best WHERE score < 4.5),
pairs AS (SELECT key % 97 AS group_id, key AS seed_key, key + 1 AS candidate_key, 1 - (key % 100) / 1000 AS similarity FROM images),
st AS (SELECT key, stack_id FROM images JOIN reps USING (stack_id) WHERE stack_size > 1)
SELECT p.group_id, p.seed_key, p.candidate_key, p.similarity, (a.stack_id IS NOT NULL)::INT + (b.stack_id IS NOT NULL)::INT AS stack_status, abs(CAST(epoch(x.date_taken) AS BIGINT) - CAST(epoch(y.date_taken) AS BIGINT)) AS gap
FROM pairs p JOIN images x ON x.key = p.seed_key JOIN images y ON y.key = p.candidate_key LEFT JOIN st a ON a.key = p.seed_key LEFT JOIN st b ON b.key = p.candidate_key
WHERE p.seed_key % 5 <> 0 AND p.seed_key NOT IN (SELECT key FROM blank) AND p.candidate_key NOT IN (SELECT key FROM blank) AND (a.stack_id IS NULL OR b.stack_id IS NULL OR a.stack_id <> b.stack_id)"""
)
def pending_suggestions(spark, d):
    """Pairs still to decide, of consecutive images, where every fifth was rejected."""
    pairs = _pairs(spark, d)
    rejected = pairs.where("seed_key % 5 = 0").select(F.col("seed_key").alias("key_a"), F.col("candidate_key").alias("key_b"))
    fields = D.stack_fields(spark, d).where("stack_size > 1")
    images = D.images(spark, d).withColumn("date_taken", F.col("date_taken").cast("timestamp"))
    return K.pending_suggestions(pairs, images, fields, rejected, K.blank_keys(S.best_score(D.scores(spark, d))))


# --- vectors -----------------------------------------------------------------

_SIMS = """v AS (SELECT vec_id AS key, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT a.key AS seed, b.key, b.label, list_cosine_similarity(a.e, b.e) AS sim FROM v a CROSS JOIN v b{where}),
top AS (SELECT seed, key, label, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY seed ORDER BY round(sim, 9) DESC, key) AS rank FROM near)"""


@query("WITH " + _SIMS.format(where=" WHERE a.key % 20 = 0") + " SELECT seed, key, similarity, rank FROM top WHERE rank <= 10")
def knn_topk(spark, d):
    """Ten nearest vectors of every twentieth."""
    v = D.vectors(spark, d).select("key", "embedding")
    return V.nearest(v.where("key % 20 = 0"), v, 10).withColumn("similarity", F.round("similarity", 6))


#: Vectors hidden by a stack, blank ones, and pairs that were rejected.
_STATES = "hid AS (SELECT key FROM v WHERE key % 13 = 4), blk AS (SELECT key FROM v WHERE key % 17 = 3), rej AS (SELECT key AS key_a, key + 1 AS key_b FROM v WHERE key % 3 = 0)"


def _vector_states(v):
    return v.where("key % 13 = 4").select("key"), v.where("key % 17 = 3").select("key"), v.where("key % 3 = 0").select(F.col("key").alias("key_a"), (F.col("key") + 1).alias("key_b"))


@query("WITH " + _SIMS.format(where=" WHERE a.key = 20") + ", " + _STATES + " SELECT seed, key, similarity FROM top WHERE rank <= 400 AND key <> 20 AND label % 2 = 0 AND key NOT IN (SELECT key FROM hid) ORDER BY rank LIMIT 20")
def similar_filtered(spark, d):
    """A page of images like one, filtered after the nearest were taken."""
    v = D.vectors(spark, d)
    found = V.similar(v.where("key = 20").select("key", "embedding"), v.select("key", "embedding"), _vector_states(v)[0], v.where("label % 2 = 0"), limit=20)
    return found.select("seed", "key", F.round("similarity", 6).alias("similarity"))


def _similar_pairs(v, states):
    return V.similar_pairs(v, states[0], states[1], threshold=0.3)


_GROUPS = f"""{_STATES},
own AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY rank) AS n FROM top WHERE rank <= 160 AND seed <> key AND key NOT IN (SELECT key FROM hid) AND seed NOT IN (SELECT key FROM hid) AND seed NOT IN (SELECT key FROM blk)),
over_floor AS (SELECT * FROM own WHERE n <= 8 AND similarity >= 0.3),
good AS (SELECT o.* FROM over_floor o LEFT JOIN rej ON rej.key_a = least(seed, key) AND rej.key_b = greatest(seed, key) WHERE rej.key_a IS NULL AND key NOT IN (SELECT key FROM blk)),
once AS (SELECT *, row_number() OVER (PARTITION BY least(seed, key), greatest(seed, key) ORDER BY seed DESC) AS o FROM good)"""


@query("WITH " + _SIMS.format(where="") + ", " + _GROUPS + " SELECT seed AS seed_key, key AS candidate_key, similarity, row_number() OVER (PARTITION BY seed ORDER BY n) AS rank FROM once WHERE o = 1")
def similarity_groups(spark, d):
    """Similar pairs of all seeds, the newest (largest key) first, each pair once, without hidden, blank and rejected ones."""
    v = D.vectors(spark, d)
    states = _vector_states(v)
    found = V.similarity_candidates(_similar_pairs(v, states), v.select("key", (-F.col("key")).alias("seed_rank")), *states[1:])
    return found.withColumn("similarity", F.round("similarity", 6))


@query("WITH " + _SIMS.format(where="") + ", " + _GROUPS + " SELECT seed AS seed_key, count(*) AS candidate_count, max(similarity) AS best_similarity FROM once WHERE o = 1 GROUP BY seed")
def similarity_group_rows(spark, d):
    """The groups of the same pairs."""
    return V.similarity_groups(similarity_groups(spark, d))


@query("WITH " + _SIMS.format(where="") + ", " + _GROUPS + """
SELECT (SELECT count(*) FROM v) AS embedded_catalog_images, (SELECT count(*) FROM hid) AS skipped_non_primary, (SELECT count(*) FROM v WHERE e IS NULL AND key NOT IN (SELECT key FROM hid) AND key NOT IN (SELECT key FROM blk)) AS skipped_no_embedding,
       (SELECT count(*) FROM over_floor JOIN rej ON rej.key_a = least(seed, key) AND rej.key_b = greatest(seed, key)) AS skipped_rejected,
       (SELECT count(*) FROM blk WHERE key NOT IN (SELECT key FROM hid)) + (SELECT count(*) FROM over_floor LEFT JOIN rej ON rej.key_a = least(seed, key) AND rej.key_b = greatest(seed, key) WHERE rej.key_a IS NULL AND key IN (SELECT key FROM blk)) AS skipped_blank_frame,
       (SELECT count(DISTINCT seed) FROM once WHERE o = 1) AS groups_created, (SELECT count(*) FROM once WHERE o = 1) AS candidates_created""")
def similarity_counters(spark, d):
    """What became of the seeds of the same pairs."""
    v = D.vectors(spark, d)
    states = _vector_states(v)
    pairs = work.written(_similar_pairs(v, states), "pairs")
    candidates = V.similarity_candidates(pairs, v.select("key", (-F.col("key")).alias("seed_rank")), *states[1:])
    return V.similarity_counters(v, *states, pairs, candidates)


@query("WITH " + _SIMS.format(where=" WHERE a.key = 20") + ", " + _STATES + " SELECT key, rank FROM top WHERE key <> 20 AND rank <= 500 AND key NOT IN (SELECT key FROM hid) UNION ALL SELECT 20, 0")
def pin_candidates(spark, d):
    """A seed and its nearest primary images."""
    v = D.vectors(spark, d)
    return V.pin_candidates(v.where("key = 20").select("key", "embedding"), v.select("key", "embedding"), _vector_states(v)[0])


# --- sync, upserts -----------------------------------------------------------


def _sides(spark, d):
    keys = D.images(spark, d).select(F.col("key").alias("id"))
    return keys.where("id % 11 <> 0").select(F.concat(F.lit(" "), F.col("id").cast("string")).alias("id")), keys.where("id % 13 <> 0").select(F.col("id").cast("string").alias("id"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0")
def sync_missing(spark, d):
    """Ids to fetch."""
    return Y.missing(*_sides(spark, d))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0")
def sync_stale(spark, d):
    """Ids to drop."""
    return Y.stale(*_sides(spark, d))


@query("SELECT count_if(o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0)::BIGINT AS missing, count_if(o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0)::BIGINT AS stale, count_if(o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0)::BIGINT AS in_both FROM orders")
def sync_counts(spark, d):
    """Counts of a sync."""
    return Y.sync_counts(*_sides(spark, d))


@query(ALL + "SELECT key, CASE WHEN key % 3 = 0 THEN 9 ELSE rating END AS rating, posted AS instagram_posted, date_taken FROM images")
def upsert_latest(spark, d):
    """Images after every third came in again with another rating; whether it was posted survives."""
    old = D.images(spark, d).select("key", "rating", "instagram_posted", "date_taken")
    new = old.where("key % 3 = 0").withColumns({"rating": F.lit(9), "instagram_posted": F.lit(5)})
    return Y.upsert(old, new, "key", "date_taken", keep_old=("instagram_posted",))


# --- jobs --------------------------------------------------------------------


@query("SELECT user_id AS job_id, count(*) AS total, count_if(event_type = 'warning')::BIGINT AS warnings, count_if(event_type = 'error')::BIGINT AS errors, max(ts) AS last_ts FROM events GROUP BY user_id")
def log_stats(spark, d):
    """Log counts of each job."""
    return J.log_stats(D.logs(spark, d))


@query("SELECT job_id, id, level FROM (SELECT user_id AS job_id, event_id AS id, event_type AS level, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) q WHERE n <= 5")
def log_tail(spark, d):
    """The last rows of each job's log."""
    return J.log_tail(D.logs(spark, d), 5).select("job_id", "id", "level")


@query("SELECT event_type AS bucket, user_id AS job_id, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) q WHERE n = 1")
def latest_job(spark, d):
    """The newest job of each bucket."""
    return J.latest_per(D.logs(spark, d).withColumnRenamed("ts", "created_at"), F.col("level")).select("bucket", "job_id", "id")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark, d):
    """Jobs by status."""
    return J.status_counts(D.logs(spark, d).withColumnRenamed("level", "status"))


@query("SELECT round(sum(greatest(0, least(epoch(ts) + value, 1704153600) - greatest(epoch(ts), 1704153600 - 3600))), 3) AS seconds FROM events")
def rolling_usage(spark, d):
    """Time that jobs took within an hour."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = D.logs(spark, d).select(start.alias("start_s"), (start + F.col("value")).alias("end_s"))
    return J.rolling_usage(rows, F.lit(1704153600.0), 3600.0).select(F.round("seconds", 3).alias("seconds"))


# --- lookups, states, write-back ----------------------------------------------


@query(ALL.rstrip() + ", best AS (SELECT image_key, score, slug FROM (SELECT *, row_number() OVER (PARTITION BY image_key ORDER BY score DESC, slug) AS rn FROM scores) q WHERE rn = 1) SELECT i.key, i.rating, i.stack_id, r.representative_key, r.stack_size, b.score AS best_score, b.slug AS best_lens, d.n_chars FROM images i LEFT JOIN reps r USING (stack_id) LEFT JOIN best b ON b.image_key = i.key LEFT JOIN documents d ON d.doc_id = i.key WHERE i.key = 42")
def image_detail(spark, d):
    """One image with all that is known of it."""
    texts = D.descriptions(spark, d).select("key", "n_chars")
    rows = C.image_detail(D.images(spark, d), D.stack_fields(spark, d), S.best_score(D.scores(spark, d)), texts, 42)
    return rows.select("key", "rating", "stack_id", "representative_key", "stack_size", "best_score", "best_lens", "n_chars")


@query(ALL.rstrip() + """, pairs AS (SELECT key % 97 AS group_id, key + 1 AS candidate_key, 1 - (key % 100) / 1000 AS similarity, row_number() OVER (PARTITION BY key % 97 ORDER BY key) AS rank FROM images),
groups AS (SELECT group_id, min(key) AS seed_key FROM (SELECT key % 97 AS group_id, key FROM images) q GROUP BY group_id),
shown AS (SELECT * FROM groups WHERE seed_key NOT IN (SELECT key FROM hidden) ORDER BY seed_key DESC, group_id DESC LIMIT 5)
SELECT g.group_id, g.seed_key, p.candidate_key, i.rating, p.rank FROM shown g JOIN pairs p USING (group_id) JOIN images i ON i.key = p.candidate_key""")
def similarity_groups_page(spark, d):
    """A page of groups with their members."""
    from pyspark.sql import Window

    pairs = _pairs(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy("seed_key")))
    groups = pairs.groupBy("group_id").agg(F.min("seed_key").alias("seed_key")).withColumn("created_at", F.col("seed_key"))
    found = C.groups_page(groups, pairs.select("group_id", "candidate_key", "similarity", "rank"), D.images(spark, d), K.hidden_members(D.stack_fields(spark, d)), limit=5)
    return found.select("group_id", "seed_key", "candidate_key", "rating", "rank")


@query("SELECT (SELECT count(*) FROM orders) AS total, count(*) AS cached, (SELECT count(*) FROM orders) - count(*) AS missing, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END) AS BIGINT) AS bytes FROM documents")
def cache_stats(spark, d):
    """Documents as cached files of orders; every third file is gone."""
    texts = D.descriptions(spark, d).withColumn("compressed_path", F.concat(F.lit("/c/"), F.col("key").cast("string")))
    files = texts.where("key % 3 <> 0").select(F.col("compressed_path").alias("path"), F.col("n_chars").alias("size"))
    return C.cache_stats(D.images(spark, d), texts, files)


@query("SELECT CASE WHEN doc_id IS NOT NULL THEN 'cached' WHEN o_orderkey % 5 = 0 THEN 'empty_path' WHEN o_orderkey % 7 = 0 THEN 'unresolved' ELSE 'readable' END AS state, count(*) AS n FROM orders LEFT JOIN documents ON doc_id = o_orderkey GROUP BY 1")
def path_states(spark, d):
    """Images by what can be read of them."""
    rows = D.images(spark, d).withColumn("filepath", F.when(F.col("key") % 5 == 0, "  ").otherwise(F.concat(F.lit("/p/"), F.col("key").cast("string"))))
    files = rows.where("key % 7 <> 0").select(F.col("filepath").alias("path"))
    return C.classify_paths(rows, rows, D.descriptions(spark, d), files).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'error' WHEN o_orderkey % 3 = 0 THEN 'skipped' ELSE 'added' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def keyword_write_back(spark, d):
    """What writing a keyword to the source would do."""
    rows = D.images(spark, d).select("key")
    source = rows.where("key % 4 <> 0").select(F.col("key").alias("image"), F.concat(F.lit("img"), F.col("key").cast("string")).alias("base"))
    links = rows.where("key % 3 = 0").select(F.col("key").alias("image"), F.lit(7).alias("tag"))
    wanted = rows.select(F.concat(F.lit("2024-01-01_img"), F.col("key").cast("string"), F.lit(".jpg")).alias("key"))
    return Y.keyword_write_back(wanted, source, links, 7).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT reason, coalesce(n, 0) AS n FROM (VALUES ('click'), ('error'), ('never')) v(reason) LEFT JOIN (SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1) q USING (reason)")
def skip_histogram(spark, d):
    """Rows over fixed buckets, the empty one included."""
    return C.skip_histogram(D.logs(spark, d).withColumnRenamed("level", "reason"), ("click", "error", "never"))
