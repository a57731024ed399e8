"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import audit, bpe, caps, decontaminate, html, langid, lines, minhash, phrases, quality, repeats, toxicity, warc
from shutterlake.llm.common import read_table

#: The vocabulary of op1 and of the pipeline's last stage.
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The vocabulary whose pieces op6 counts.
LANGUAGE_PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, as digests, with the digest of the text decoded from them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, BPE_RANKS, public_tokenizers.PATTERN, ids_bytes="raw")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("raw", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), BPE_RANKS), 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, from a model of the labelled ones."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, toxicity.grades(read_table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).drop("text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, lines deleted as later copies, and the digest of what is left."""
    docs = lines.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 200-byte string that starts elsewhere too, and the digest of the others."""
    cut = repeats.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors with cosine 0.95 or more."""
    return caps.near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.learn(docs.where(~F.col("held_out")), LANGUAGE_PIECES)
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages, html.learn(pages))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the archives written from all pages, as read back from them."""
    folder = warc.archive(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = warc.read(spark, folder, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets are alike to 85 percent."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair where the document contains the item."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contained(docs, read_table(spark, sf_dir, "benchmark"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labelled ones that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.held_out(F.col("doc_id")))
    labels = read_table(spark, sf_dir, "labels").where(~langid.held_out(F.col("doc_id")))
    return quality.score(docs, quality.learn(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by language and step."""
    found = audit.interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return phrases.collocations(read_table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The counts of op12 by replaying every order over every document.
OP12_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
failed AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM words JOIN firsts USING (t) LEFT JOIN known USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
placed AS (
  SELECT part, good, toxic, fails, filter_order, coalesce(list_min([k FOR k IN [1, 2, 3, 4, 5] IF contains(fails, substr(filter_order, k, 1))]), 6) AS place
  FROM failed, orders),
steps AS (SELECT *, unnest([1, 2, 3, 4, 5])::INT AS step FROM placed),
counts AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, count_if(place > step)::BIGINT AS kept, count_if(place = step)::BIGINT AS removed,
         count_if(contains(fails, substr(filter_order, step, 1)) AND place < step)::BIGINT AS redundant, count_if(fails = substr(filter_order, step, 1))::BIGINT AS unique_fails,
         count_if(place = step AND good)::BIGINT AS good_lost, count_if(place = step AND toxic)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM counts
"""

#: The phrases of op13 by counting every pair and triple of words.
OP13_SQL = r"""
WITH pieces AS (
  SELECT doc_id, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS no FROM (
    SELECT row_number() OVER () AS doc_id, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
words AS (
  SELECT doc_id, lang, no, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, lang, no, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)),
runs AS (SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY doc_id, no ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) q GROUP BY ALL),
cuts AS (
  SELECT f2.lang, w1 || ' ' || w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r, coalesce(100 * most >= 50 * f2.f, FALSE) AS gone
  FROM f2 JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2 LEFT JOIN longer USING (lang, w1, w2)
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.f, 1, x.f, y.f, FALSE FROM f3 JOIN f1 x USING (lang, w1) JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.f, 2, x.f, y.f, FALSE FROM f3 JOIN f2 x USING (lang, w1, w2) JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts WHERE NOT gone),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

#: The pairs of op10 by joining all shingles.
OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
items AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS span, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS shingle
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM item_words WHERE len(w) > 0)),
spans AS (SELECT DISTINCT span FROM items),
doc_shingles AS (
  SELECT DISTINCT doc_id, span, array_to_string(w[i:i + span - 1], ' ') AS shingle
  FROM (SELECT doc_id, span, w, unnest(range(1, len(w) - span + 2)) AS i FROM doc_words, spans WHERE len(w) >= span)),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_common, any_value(n) AS n_item, count(*) / any_value(n) AS containment
FROM items JOIN doc_shingles USING (span, shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n) - 1e-9
"""

#: The records of op9 from the pages alone.
OP9_SQL = """
WITH base AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM base WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, base.payload_digest AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
       TRUE AS intact
FROM base LEFT JOIN firsts ON base.payload_digest = firsts.payload_digest
"""

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_spherical_caps": op5_spherical_caps,
    "op6_language_id": op6_language_id,
    "op7_minhash": op7_minhash,
    "op8_html_extraction": op8_html_extraction,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_quality": op11_quality,
    "op12_filter_audit": op12_filter_audit,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {"op9_warc": OP9_SQL, "op10_decontamination": OP10_SQL, "op12_filter_audit": OP12_SQL, "op13_collocations": OP13_SQL}
