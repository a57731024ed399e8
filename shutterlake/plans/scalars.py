"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import scalars as X
from shutterlake.functions import udfs as U
from shutterlake.plans.base import query, sql_round
from shutterlake.sources import driver as D


def _picked(values: list, n):
    """One of some literal texts, by a number."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))).cast("int"))


def _sql_picked(values: list, n: str) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[CAST({n} % {len(values)} AS INT) + 1]"


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END || '_' || CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE o_orderpriority END AS key FROM orders")
def image_keys(spark, d):
    """Keys of images, some without a date or a name."""
    n = F.col("o_orderkey")
    date = F.when(n % 7 != 0, F.col("o_orderdate").cast("string"))
    name = F.when(n % 10 == 0, "").when(n % 5 != 0, F.col("o_orderpriority"))
    return D.table(spark, d, "orders").select(n.alias("id"), X.image_key(date, name).alias("key"))


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '' ELSE trim(regexp_replace(p_name, '\\s+', ' ', 'g')) END
       || CASE WHEN p_partkey % 4 = 0 OR p_partkey % 3 = 2 THEN '' ELSE ' ' END || CASE p_partkey % 3 WHEN 0 THEN 'two words' WHEN 1 THEN 'blue sky' ELSE '' END AS document FROM part"""
)
def search_documents(spark, d):
    """Texts that are searched: summaries with those subjects that are strings."""
    n = F.col("p_partkey")
    subjects = F.when(n % 3 == 0, '["two  words", 3, {"a": 1}, null, true]').when(n % 3 == 1, '[1.5, "blue", ["x"], " sky "]').otherwise("not json")
    summary = F.when(n % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit(" \t")))
    return D.table(spark, d, "part").select(n.alias("id"), X.search_document(summary, subjects).alias("document"))


@query("SELECT doc_id AS id, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(t[1:239]) || '…' END AS preview FROM (SELECT doc_id, trim(text, ' ') AS t FROM documents) q")
def previews(spark, d):
    """The beginning of every text."""
    return D.table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.preview(F.col("text")).alias("preview"))


_MARKS = ["<!-- optional: true -->", "# T\n<!--OPTIONAL :TRUE-->\nx", "<!-- optional: false -->", "", "plain"]
_SLUGS = ["street_photo", "LIGHT (beta)", " mood ", "a_b (x) (y)", "night"]


@query(
    f"""SELECT p_partkey AS id, md LIKE '%rue -->%' OR md LIKE '%TRUE-->%' AS optional, slug || ':' || sha256(md)[1:16] AS prompt_version, lower(trim(regexp_replace(slug, '\\s*\\([^)]*\\)\\s*$', ''))) AS normal_slug,
       array_to_string(list_transform(string_split(replace(word, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS display_name
FROM (SELECT p_partkey, {_sql_picked(_MARKS, "p_partkey")} AS md, {_sql_picked(_SLUGS, "p_partkey")} AS slug, replace(p_name, ' ', '_') AS word FROM part) q"""
)
def prompt_fields(spark, d):
    """What is derived of prompts: marker, version, slug, display name."""
    n = F.col("p_partkey")
    md, slug = _picked(_MARKS, n), _picked(_SLUGS, n)
    return D.table(spark, d, "part").select(n.alias("id"), X.optional_marker(md).alias("optional"), X.prompt_version(slug, md).alias("prompt_version"), X.normal_slug(slug).alias("normal_slug"), X.display_name(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("display_name"))


@query("SELECT o_orderkey AS id, greatest(0.0, least(1.0, 1 - (o_orderkey % 250) / 200)) AS similarity, 'Visual match (' || CAST(round_even(greatest(0.0, least(1.0, 1 - (o_orderkey % 250) / 200)) * 100, 0) AS INT) || '%)' AS label FROM orders")
def match_labels(spark, d):
    """Similarities of distances within and beyond 0 and 1, with their labels."""
    sim = X.similarity((F.col("o_orderkey") % 250) / 200)
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), sim.alias("similarity"), X.match_label(sim).alias("label"))


_PATHS = ["/a/b.MOV", "/a/b.3gp", "/a.mts/b.jpg", "/a/b.M2TS", "/a/b.flv", "/a/b.mpg", "/a/b.sr2", "/a/b.pef", "/a/b.CR3", "/a/mov", "/a/b.dng", "/a/b.webm", None]


@query(
    f"""SELECT o_orderkey AS id, path IS NOT NULL AND NOT regexp_matches(lower(path), '\\.(mov|mp4|avi|mkv|wmv|m4v|3gp|webm|mts|m2ts)$') AS not_video,
       regexp_matches(lower(path), '\\.(dng|raw|cr2|cr3|nef|arw|rw2|orf|raf|sr2|srw|x3f)$') AS raw FROM (SELECT o_orderkey, {_sql_picked(_PATHS, "o_orderkey")} AS path FROM orders) q"""
)
def file_kinds(spark, d):
    """Which paths are no videos, and which are raw files."""
    path = _picked(_PATHS, F.col("o_orderkey"))
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.not_video(path).alias("not_video"), X.has_ending(path, X.RAW_ENDINGS).alias("raw"))


_FLAGS = ["1", "true", "yes", " TRUE ", "y", "True", "0", "no", None, "1.0", ""]


@query(f"SELECT o_orderkey AS id, CASE WHEN flag IS NULL THEN NULL WHEN flag IN ('1', 'true', 'yes') THEN 1 ELSE 0 END AS of_text, CASE WHEN o_orderkey % 4 / 2 = 1.0 THEN 1 ELSE 0 END AS of_number, CAST(o_orderkey % 3 = 0 AS INT) AS of_boolean FROM (SELECT o_orderkey, {_sql_picked(_FLAGS, 'o_orderkey')} AS flag FROM orders) q")
def repetition_flags(spark, d):
    """Flags given as text, as numbers and as booleans."""
    n = F.col("o_orderkey")
    return D.table(spark, d, "orders").select(n.alias("id"), X.repetition_flag(_picked(_FLAGS, n)).alias("of_text"), X.repetition_flag((n % 4) / 2).alias("of_number"), X.repetition_flag(n % 3 == 0).alias("of_boolean"))


_SCORES_JSON = {"7": 7, "10": 10, "0": None, "11": None, "8.0": 8, "8.5": None, '" 9 "': 9, '"007"': 7, '"8.0"': None, "true": None, "null": None, '"x"': None, "[1]": None, "not json": None}


@query(f"SELECT o_orderkey AS id, ([{', '.join('NULL' if v is None else str(v) for v in _SCORES_JSON.values())}])[CAST(o_orderkey % {len(_SCORES_JSON)} AS INT) + 1] AS score FROM orders")
def legacy_scores(spark, d):
    """Scores of loosely typed JSON values."""
    n = F.col("o_orderkey")
    return D.table(spark, d, "orders").select(n.alias("id"), X.typed_score(F.try_parse_json(_picked(list(_SCORES_JSON), n))).cast("int").alias("score"))


@query("SELECT doc_id AS id, len(list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+'), lambda w: trim(w, '''')), lambda w: length(w) >= 3 AND NOT list_contains(string_split('" + " ".join(X.STOP_WORDS) + "', ' '), w))) AS tokens FROM documents WHERE text IS NOT NULL")
def rationale_token_counts(spark, d):
    """Words of every text that are long enough and no stop words."""
    return D.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.size(X.rationale_tokens(F.col("text"))).cast("long").alias("tokens"))


@query("SELECT event_id AS id, abs(CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) END - CAST(floor(epoch(TIMESTAMP '2024-01-01 06:00:00')) AS BIGINT)) AS gap, round(epoch_us(ts) / 1e6, 6) AS at FROM events")
def time_gaps(spark, d):
    """Whole seconds between times, where a missing one is the epoch, and times as numbers."""
    ts = F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp"))
    return D.table(spark, d, "events").select(F.col("event_id").alias("id"), X.gap_seconds(ts, F.lit("2024-01-01 06:00:00").cast("timestamp")).alias("gap"), F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 6).alias("at"))


_DATES = {"2024-03-31T10:00:00": ("2024-03-31T10:00:00", "202403"), "2024-03-31T23:30:00-05:00": ("2024-03-31T23:30:00-05:00", "202404"), "2024": ("2024", None), "": (None, None), "soon": ("soon", None), "2024-2-3T4:5:6": ("2024-02-03T04:05:06", None), "2023-12-31": ("2023-12-31", "202312"), "2024-01-01T00:30:00Z": ("2024-01-01T00:30:00Z", "202401")}
_NUMBERS = {"12.5": 12.5, "-0.25": -0.25, "": None, "north": None, " 7 ": 7.0}


def _sql_values(values: list, n: str) -> str:
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[CAST({n} % {len(values)} AS INT) + 1]"


@query(f"SELECT o_orderkey AS id, {_sql_values([v[0] for v in _DATES.values()], 'o_orderkey')} AS date_taken, {_sql_values([v[1] for v in _DATES.values()], 'o_orderkey')} AS month, CAST({_sql_values(list(_NUMBERS.values()), 'o_orderkey')} AS DOUBLE) AS gps FROM orders")
def source_dates(spark, d):
    """Dates and coordinates of a source catalog, and months of dates."""
    n = F.col("o_orderkey")
    date = _picked(list(_DATES), n)
    return D.table(spark, d, "orders").select(n.alias("id"), X.source_date(date).alias("date_taken"), X.year_month(date).alias("month"), X.source_number(_picked(list(_NUMBERS), n)).alias("gps"))


_ANSWERS = {
    '{"a": 1, "b": [1, 2,],}': '{"a": 1, "b": [1, 2]}',
    '```json\n{"a": 1}\n```': '{"a": 1}',
    '  {"a": {"b": 1,},}  ': '{"a": {"b": 1}}',
    'so:\n```\n[1]\n``` done': "[1]",
    "plain": "plain",
    "[1,,]": "[1]",
    "": "",
}


@query(f"SELECT o_orderkey AS id, {_sql_picked(list(_ANSWERS.values()), 'o_orderkey')} AS repaired FROM orders")
def repaired_json(spark, d):
    """Answers of a model without fences and trailing commas."""
    n = F.col("o_orderkey")
    return D.table(spark, d, "orders").select(n.alias("id"), U.repair_json(_picked(list(_ANSWERS), n)).alias("repaired"))


_REPLIES = {
    '{"perspective_slug": "light", "score": 7, "rationale": "good"}': ("light", 7, "good", False),
    '```\n{"perspective_slug": "mood", "score": 10, "rationale": "x", "not_attempted": true,}\n```': ("mood", 10, "x", True),
    '{"perspective_slug": "light", "score": 0, "rationale": "good"}': None,
    '{"perspective_slug": "light", "score": 11, "rationale": "good"}': None,
    '{"perspective_slug": "light", "score": 7}': None,
    '{"perspective_slug": "light", "score": 7, "rationale": "good", "more": 1}': None,
    '{"perspective_slug": 5, "score": 7, "rationale": "good"}': None,
    '{"perspective_slug": "light", "score": 7.5, "rationale": "good"}': None,
    "no json": None,
}


def _sql_reply(place: int) -> str:
    values = [None if v is None else v[place] for v in _REPLIES.values()]
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[CAST(o_orderkey % {len(values)} AS INT) + 1]"


@query(f"SELECT o_orderkey AS id, {_sql_reply(0)} AS perspective_slug, {_sql_reply(1)} AS score, {_sql_reply(2)} AS rationale, {_sql_reply(3)} AS not_attempted, {_sql_reply(1)} IS NOT NULL AS valid FROM orders")
def score_replies(spark, d):
    """Scores of a model's answers, read strictly."""
    n = F.col("o_orderkey")
    got = U.parse_score(_picked(list(_REPLIES), n))
    return D.table(spark, d, "orders").select(n.alias("id"), got.alias("r")).select("id", "r.perspective_slug", "r.score", "r.rationale", "r.not_attempted", F.col("r.error").isNull().alias("valid"))


_VISUAL = {
    ('["red"]', '["calm"]', "{}"): ('["red"]', '["calm"]'),
    ("[]", "[]", '{"dominant_colors":["blue"],"mood":"dark"}'): ('["blue"]', "[]"),
    (None, None, '{"dominant_colors":["blue"],"mood":" dark "}'): ('["blue"]', '["dark"]'),
    ("3", '"calm"', '{"dominant_colors":"blue"}'): (None, None),
    (None, None, None): (None, None),
}


@query(f"SELECT o_orderkey AS id, {_sql_picked([v[0] for v in _VISUAL.values()], 'o_orderkey')} AS colors, {_sql_picked([v[1] for v in _VISUAL.values()], 'o_orderkey')} AS moods, {_sql_picked([k[0] if k[0] and k[0][0] == '[' else None for k in _VISUAL], 'o_orderkey')} AS stored FROM orders")
def visual_lists(spark, d):
    """Colour and mood lists of descriptions with their fallbacks, and lists as they are stored."""
    n = F.col("o_orderkey")
    own, mood, technical = (_picked([k[i] for k in _VISUAL], n) for i in range(3))
    colors, moods = X.visual_attributes(own, mood, technical)
    return D.table(spark, d, "orders").select(n.alias("id"), colors.alias("colors"), moods.alias("moods"), X.json_list_or_map(own).alias("stored"))


@query("SELECT o_orderkey AS id, CAST(floor(least(100, 5 + (o_orderkey % 4) * 23.75 + (greatest(5, least(100, o_orderkey % 120)) - 5) / 95 * 23.75)) AS INT) AS staged, CAST(floor(20 + 60 * (o_orderkey % 101) / 100) AS INT) AS ranged FROM orders")
def job_progress(spark, d):
    """Progress of stages within a whole run, and of a part within a range."""
    n = F.col("o_orderkey")
    return D.table(spark, d, "orders").select(n.alias("id"), X.stage_progress(n % 4, n % 120).alias("staged"), X.range_progress(n % 101, 20, 80).alias("ranged"))


@query(
    f"""WITH t AS (SELECT DISTINCT CAST(l_quantity AS INT) % 13 AS k, 12 + l_linenumber AS n, l_linenumber / 10 AS p FROM lineitem)
SELECT k, n, p, {sql_round("list_sum(list_transform(range(k, n + 1), lambda i: CAST(factorial(CAST(n AS INT)) AS DOUBLE) / (CAST(factorial(CAST(i AS INT)) AS DOUBLE) * CAST(factorial(CAST(n - i AS INT)) AS DOUBLE)) * p ** i * (1 - p) ** (n - i)))", 9)} AS tail FROM t"""
)
def binomial_tails(spark, d):
    """Exact tails of binomials of few trials."""
    rows = D.table(spark, d, "lineitem").select((F.col("l_quantity").cast("int") % 13).alias("k"), (12 + F.col("l_linenumber")).alias("n"), (F.col("l_linenumber") / 10).alias("p")).distinct()
    return rows.withColumn("tail", X.exact_round(U.binom_sf("k", "n", "p"), 9))


@query(f"SELECT o_orderkey AS id, {sql_round('o_totalprice / 8', 1)} AS one, {sql_round('o_totalprice / 3', 4)} AS four, {sql_round('o_orderkey / 200', 2)} AS two, {sql_round('-o_orderkey / 8', 2)} AS below FROM orders")
def exact_rounding(spark, d):
    """Numbers rounded as the binary values that they are, ties among them."""
    price, n = F.col("o_totalprice"), F.col("o_orderkey")
    return D.table(spark, d, "orders").select(n.alias("id"), X.exact_round(price / 8, 1).alias("one"), X.exact_round(price / 3, 4).alias("four"), X.exact_round(n / 200, 2).alias("two"), X.exact_round(-n / 8, 2).alias("below"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'body' ELSE '' END AS line FROM part")
def body_lines(spark, d):
    """The first line of prompts that is neither blank nor the heading."""
    n = F.col("p_partkey")
    md = F.when(n % 3 == 0, F.concat(F.lit("\n# Title\n\n  "), F.col("p_name"), F.lit("  \nmore"))).when(n % 3 == 1, "body\n# Title").otherwise("# Only a title\n")
    return D.table(spark, d, "part").select(n.alias("id"), U.first_body_line(md).alias("line"))
