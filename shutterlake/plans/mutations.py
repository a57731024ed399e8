"""Tables after changes: functions from the old snapshot and the new rows to the new one."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import catalog as C
from shutterlake.operators import scores as S
from shutterlake.operators import stacks as K
from shutterlake.operators import sync as Y
from shutterlake.plans.base import ALL, query
from shutterlake.sources import driver as D


def _rows(spark, d):
    return D.images(spark, d).select("key", "rating", "instagram_posted", "date_taken")


@query(ALL + "SELECT key, CASE WHEN key % 3 = 0 THEN CASE WHEN key % 2 = 0 THEN 'new' ELSE 'old' END ELSE 'old' END AS phash, CASE WHEN key % 3 = 0 THEN 'E' ELSE 'e' END AS exif, posted AS instagram_posted FROM images WHERE key % 4 <> 3 UNION ALL SELECT key, CASE WHEN key % 2 = 0 THEN 'new' END, 'E', 5 FROM images WHERE key % 4 = 3 AND key % 3 = 0")
def upsert_catalog_images(spark, d):
    """Images after others came in, where an unknown hash does not erase a known one."""
    base = _rows(spark, d).withColumns({"catalog_path": F.lit("p"), "description": F.lit("d"), "analyzed_at": F.lit("1")})
    old = base.where("key % 4 <> 3").withColumns({"phash": F.lit("old"), "exif": F.lit("e")})
    new = base.where("key % 3 = 0").withColumns({"phash": F.when(F.col("key") % 2 == 0, "new"), "exif": F.lit("E"), "instagram_posted": F.lit(5), "analyzed_at": F.lit("2")})
    return Y.upsert_catalog_images(old, new).select("key", "phash", "exif", "instagram_posted")


@query("""WITH t AS (SELECT doc_id AS key, doc_id % 3 = 0 AS new, doc_id % 5 <> 0 AS old FROM documents)
SELECT key, CASE WHEN new THEN 'blue sky and more' ELSE 'an old text' END AS document, CASE WHEN new THEN CASE WHEN key % 2 = 0 THEN '["red"]' END ELSE '["old"]' END AS colors,
       CASE WHEN new THEN CASE WHEN key % 4 = 0 THEN 1 ELSE 0 END ELSE NULL END AS flag, CASE WHEN old THEN 'legacy' END AS legacy, CASE WHEN new THEN 'and,blue,more,sky' ELSE 'an,old,text' END AS tokens FROM t WHERE new OR old""")
def upsert_descriptions(spark, d):
    """Descriptions after others came in, with the stems that are searched."""
    n = F.col("image_key")
    ids = D.table(spark, d, "documents").select(F.col("doc_id").alias("image_key"))
    old = ids.where(n % 5 != 0).withColumns({"summary": F.lit("an old text"), "subjects": F.lit("[]"), "dominant_colors": F.lit('["old"]'), "mood_tags": F.lit(None).cast("string"), "has_repetition": F.lit(None).cast("long"), "perspectives": F.lit("legacy"), "best_perspective": F.lit("x"), "described_at": F.lit("1"), "description_search_document": F.lit("an old text")})
    new = ids.where(n % 3 == 0).withColumns({"summary": F.lit(" blue  sky"), "subjects": F.lit('["and more", 4]'), "dominant_colors": F.when(n % 2 == 0, '["red"]').otherwise("red"), "mood_tags": F.lit("[]"), "has_repetition": F.when(n % 4 == 0, "yes").otherwise("maybe"), "perspectives": F.lit(None).cast("string"), "best_perspective": F.lit(None).cast("string"), "described_at": F.lit("2")})
    got = Y.upsert_descriptions(old, new)
    return got.select(n.alias("key"), F.col("description_search_document").alias("document"), F.col("dominant_colors").alias("colors"), F.col("has_repetition").cast("int").alias("flag"), F.col("perspectives").alias("legacy"), F.array_join("tokens", ",").alias("tokens"))


@query("SELECT vec_id AS key, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END AS scale, embedding[1] * CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END AS first FROM embeddings")
def replaced_vectors(spark, d):
    """Vectors after every fourth was replaced."""
    old = D.vectors(spark, d).select("key", "embedding").withColumn("scale", F.lit(1))
    new = old.where("key % 4 = 0").withColumns({"embedding": F.transform("embedding", lambda x: x * F.lit(2).cast("float")), "scale": F.lit(2)})
    return Y.replace_rows(old, new, "key").select("key", "scale", F.col("embedding")[0].alias("first"))


@query(ALL + "SELECT key, CASE WHEN key % 8 = 1 THEN 1 ELSE posted END AS instagram_posted FROM images")
def set_posted(spark, d):
    """Images after some were marked as posted."""
    changes = D.images(spark, d).where("key % 8 = 1").select("key", F.lit(1).alias("instagram_posted"))
    return Y.set_values(D.images(spark, d), changes, "instagram_posted").select("key", "instagram_posted")


@query(ALL + "SELECT key FROM images WHERE key % 6 <> 2")
def deleted_images(spark, d):
    """Images after some were deleted."""
    return Y.delete_keys(D.images(spark, d), D.images(spark, d).where("key % 6 = 2")).select("key")


@query("SELECT l_orderkey AS image_key, l_linenumber AS perspective_slug, l_returnflag AS prompt_version, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_orderkey % 2 = 0) GROUP BY ALL")
def delete_version(spark, d):
    """Scores after one prompt's version was deleted for some images."""
    rows = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_key"), F.lit("catalog").alias("image_type"), F.col("l_linenumber").alias("perspective_slug"), F.col("l_returnflag").alias("prompt_version"))
    gone = rows.where("prompt_version = 'A' and image_key % 2 = 0").distinct()
    return S.delete_version(rows, gone).groupBy("image_key", "perspective_slug", "prompt_version").agg(F.count(F.lit(1)).alias("n"))


@query(ALL + "SELECT key AS key_a, key + 1 AS key_b, CASE WHEN key % 3 = 0 THEN 'old' ELSE 'new' END AS rejected_at FROM images WHERE key % 3 = 0 OR key % 4 = 0")
def rejected_pairs(spark, d):
    """Rejections after pairs came in the other way round, known ones among them."""
    rows = D.images(spark, d)
    old = rows.where("key % 3 = 0").select(F.col("key").alias("key_a"), (F.col("key") + 1).alias("key_b"), F.lit("old").alias("rejected_at"))
    new = rows.where("key % 4 = 0").select((F.col("key") + 1).alias("key_a"), F.col("key").alias("key_b"), F.lit("znew").alias("rejected_at"))
    return K.reject(old, new).withColumn("rejected_at", F.replace("rejected_at", F.lit("z"), F.lit("")))


_STACK_SQL = "WITH m AS (SELECT o_custkey AS stack_id, o_orderkey AS key FROM orders), big AS (SELECT * FROM m WHERE stack_id IN (SELECT stack_id FROM m GROUP BY stack_id HAVING count(*) >= 2)), x AS (SELECT stack_id FROM big WHERE key = (SELECT min(key) FROM big)), y AS (SELECT stack_id FROM big WHERE key = (SELECT max(key) FROM big))"


def _members(spark, d):
    rows = D.images(spark, d).select("stack_id", "key")
    return K.dissolve(rows)


def _ends(members):
    """The members of least and largest key, with their stacks."""
    row = members.agg(F.min(F.struct("key", "stack_id")).alias("a"), F.max(F.struct("key", "stack_id")).alias("b")).first()
    return row["a"], row["b"]


@query(_STACK_SQL + ", left_over AS (SELECT * FROM big WHERE key <> (SELECT min(key) FROM big)) SELECT stack_id, key FROM left_over WHERE stack_id IN (SELECT stack_id FROM left_over GROUP BY stack_id HAVING count(*) >= 2)")
def stack_split(spark, d):
    """Members after one left its stack."""
    members = _members(spark, d)
    return K.split_out(members, _ends(members)[0]["key"])


@query(_STACK_SQL + " SELECT CASE WHEN stack_id = (SELECT stack_id FROM x) THEN (SELECT stack_id FROM y) ELSE stack_id END AS stack_id, key FROM big")
def stack_merge(spark, d):
    """Members after one stack went into another."""
    members = _members(spark, d)
    a, b = _ends(members)
    return K.merge(members, a["stack_id"], b["stack_id"])


@query(_STACK_SQL + " SELECT CASE WHEN stack_id = (SELECT stack_id FROM y) THEN (SELECT stack_id FROM x) ELSE stack_id END AS stack_id, key FROM big")
def stack_accept(spark, d):
    """Members after a suggested pair of two stacks was accepted."""
    members = _members(spark, d)
    a, b = _ends(members)
    return K.accept_pair(members, a["key"], b["key"], -1)


@query(_STACK_SQL + ", moved AS (SELECT stack_id, key FROM big WHERE key NOT IN (SELECT min(key) FROM big) AND key NOT IN (SELECT max(key) FROM big)) SELECT stack_id, key FROM moved WHERE stack_id IN (SELECT stack_id FROM moved GROUP BY stack_id HAVING count(*) >= 2) UNION ALL SELECT -1, min(key) FROM big UNION ALL SELECT -1, max(key) FROM big")
def stack_create(spark, d):
    """Members after two left their stacks for a new one."""
    members = _members(spark, d)
    a, b = _ends(members)
    return K.create(members, [a["key"], b["key"]], -1)


@query(ALL + "SELECT stack_id, CASE WHEN stack_id = (SELECT min(stack_id) FROM reps) THEN -5 ELSE representative_key END AS representative_key, CASE WHEN stack_id = (SELECT min(stack_id) FROM reps) THEN 1 ELSE 0 END AS user_modified FROM reps")
def stack_representative(spark, d):
    """Stacks after the user chose another representative."""
    stacks = D.stack_fields(spark, d).select("stack_id", "representative_key").distinct().withColumn("user_modified", F.lit(0).cast("long"))
    first = stacks.agg(F.min("stack_id")).first()[0]
    return K.set_representative(stacks, first, -5)


@query("""WITH l AS (SELECT doc_id, doc_id % 4 AS kind FROM documents)
SELECT doc_id AS image_key, 'a' AS perspective_slug, 7 AS score, 'fine' AS rationale FROM l WHERE kind = 0 AND doc_id % 8 <> 0 UNION ALL SELECT doc_id, 'b', 8, NULL FROM l WHERE kind = 0 UNION ALL SELECT doc_id, 'c', 9, 'x' FROM l WHERE kind = 1""")
def backfill_legacy(spark, d):
    """Scores out of legacy JSON maps, where there is none yet."""
    n = F.col("image_key")
    maps = F.when(n % 4 == 0, '{"a":{"score":7,"analysis":"fine"},"b":{"score":"8"},"c":{"score":true}}').when(n % 4 == 1, '{"c":{"score":9.0,"analysis":"x"},"d":{"score":11}}').when(n % 4 == 2, "not json")
    rows = D.table(spark, d, "documents").select(F.col("doc_id").alias("image_key"), F.lit("catalog").alias("image_type"), F.lit("m").alias("model_used"), F.lit("1").alias("described_at")).withColumn("perspectives", maps)
    have = rows.where(n % 8 == 0).select("image_key", "image_type", F.lit("a").alias("perspective_slug"), F.lit(1).alias("is_current"))
    return S.backfill_legacy(rows, have).select("image_key", "perspective_slug", F.col("score").cast("int").alias("score"), "rationale")


@query("""WITH t AS (SELECT o_orderkey AS key, 'k' || (o_orderkey // 4) AS new_key, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS filled FROM orders)
SELECT new_key, arg_max(key, filled * 1000000000000 - key) AS key, count(*) AS children FROM t GROUP BY new_key""")
def unified_keys(spark, d):
    """One image for each new key, the one with most filled columns, and how many old rows point to it after the change."""
    n = F.col("key")
    rows = D.images(spark, d).select("key", F.concat(F.lit("k"), F.floor(n / 4).cast("string")).alias("new_key"), F.when(n % 2 == 0, "x").alias("title"), F.when(n % 3 == 0, "y").otherwise("").alias("caption"))
    kept = Y.unify_keys(rows, "new_key", ["title", "caption"])
    children = Y.remap(rows.select(n.cast("string").alias("image_key")), rows.select(n.cast("string").alias("old_key"), "new_key"), "image_key")
    return kept.select("new_key", "key").join(children.groupBy(F.col("image_key").alias("new_key")).agg(F.count(F.lit(1)).alias("children")), "new_key")


def _sync_sides(spark, d):
    n = F.col("key")
    full = D.images(spark, d).select(n.cast("string").alias("key"), n.cast("string").alias("id"), "rating", "instagram_posted", F.lit("1").alias("analyzed_at"))
    source = full.where("cast(id as bigint) % 11 <> 0")
    return source.select("id"), full.where("cast(id as bigint) % 13 <> 0"), source.withColumns({"rating": F.lit(9), "instagram_posted": F.lit(0), "analyzed_at": F.lit("2")})


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 13 = 0 THEN 9 ELSE 5 - CAST(substr(o_orderpriority, 1, 1) AS INT) END AS rating FROM orders WHERE o_orderkey % 13 <> 0 OR o_orderkey % 11 <> 0")
def synced_library(spark, d):
    """The library after a sync: what the source has and it lacked came in."""
    return Y.applied(*_sync_sides(spark, d))[0].select("key", "rating")


@query("SELECT count_if(o_orderkey % 11 <> 0)::BIGINT AS catalog_total, count_if(o_orderkey % 13 <> 0)::BIGINT AS library_total, count_if(o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0)::BIGINT AS missing_ids_count, count_if(o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0)::BIGINT AS stale, count_if(o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0)::BIGINT AS added FROM orders")
def sync_result(spark, d):
    """The counts of the same sync."""
    return Y.applied(*_sync_sides(spark, d))[1]


def _found(spark, d):
    n = F.col("key")
    images = D.images(spark, d).select("key", F.when(n % 3 != 0, "h").alias("phash"), F.when(n % 2 == 0, "e").alias("exif"), F.lit("old").alias("description"))
    found = images.select("key", F.when(n % 5 != 0, "new").alias("phash"), F.lit(None).cast("string").alias("exif"), F.lit("text").alias("description")).where("key % 7 <> 0")
    return images, found


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 <> 0 THEN 'h' WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'new' END AS phash, CASE WHEN o_orderkey % 2 = 0 THEN 'e' END AS exif, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'text' ELSE 'old' END AS description FROM orders")
def enriched_images(spark, d):
    """Images whose missing hash was found."""
    return C.enriched(*_found(spark, d))[0]


@query("SELECT count_if(o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)::BIGINT AS processed, count_if(o_orderkey % 3 <> 0)::BIGINT AS skipped, count_if(o_orderkey % 3 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0))::BIGINT AS errors FROM orders")
def enrich_result(spark, d):
    """The counts of the same."""
    return C.enriched(*_found(spark, d))[1]


@query("""SELECT p_partkey AS id, 's' || p_partkey AS slug, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END AS optional, CASE WHEN p_partkey % 2 = 0 THEN '2' ELSE '1' END AS updated_at, '1' AS created_at FROM part WHERE p_partkey % 5 <> 0""")
def upsert_perspectives(spark, d):
    """Perspectives after every second prompt was written anew."""
    n = F.col("p_partkey")
    old = D.table(spark, d, "part").where(n % 5 != 0).select(n.alias("id"), F.concat(F.lit("s"), n.cast("string")).alias("slug"), F.lit("x").alias("prompt_markdown"), F.lit(0).cast("long").alias("optional"), F.lit("1").alias("updated_at"), F.lit("1").alias("created_at"))
    new = old.where("id % 2 = 0").withColumns({"prompt_markdown": F.when(F.col("id") % 3 == 0, "<!-- OPTIONAL: true -->").otherwise("y"), "updated_at": F.lit("2"), "created_at": F.lit("9"), "id": -F.col("id")})
    return Y.upsert_perspective(old, new).drop("prompt_markdown")
