"""What the modules of queries share: the register, and the tables' roles in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The tables' roles, in SQL.
SCORES = """scores AS (
  SELECT image_key, slug, score, not_attempted, partkey FROM (
    SELECT l_orderkey AS image_key, l_linenumber AS slug, 1 + (CAST(l_quantity AS INT) % 10) AS score,
           CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS not_attempted, l_partkey AS partkey,
           row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
    FROM lineitem) q WHERE rn = 1)"""
LENSES = "lenses AS (SELECT DISTINCT l_linenumber AS slug, 'Lens ' || l_linenumber AS display_name, CASE WHEN l_linenumber <= 4 THEN 1 ELSE 0 END AS active FROM lineitem)"
IMAGES = """images AS (
  SELECT o_orderkey AS key, o_orderdate AS date_taken, 5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS rating,
         CASE o_orderstatus WHEN 'F' THEN 'Red' WHEN 'O' THEN 'green' ELSE '' END AS color_label,
         CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS posted, o_custkey AS stack_id, o_orderpriority AS title FROM orders)"""
PCT = """pop AS (SELECT s.* FROM scores s JOIN lenses p USING (slug) WHERE p.active = 1 AND s.not_attempted = 0),
pct AS (
  SELECT image_key, slug, score, CASE WHEN n = 1 THEN 1.0 ELSE ((rk - 1) + (tied + 1) / 2.0 - 1) / (n - 1) END AS pct FROM (
    SELECT *, rank() OVER (PARTITION BY slug ORDER BY score) AS rk, count(*) OVER (PARTITION BY slug, score) AS tied, count(*) OVER (PARTITION BY slug) AS n FROM pop) q)"""
STACKS = """means AS (SELECT image_key, CAST(format('{:.6f}', CAST(avg(score) AS DOUBLE)) AS DOUBLE) AS mean_score FROM scores JOIN lenses USING (slug) WHERE active = 1 GROUP BY image_key),
reps AS (
  SELECT stack_id, key AS representative_key, n AS stack_size FROM (
    SELECT i.stack_id, i.key, count(*) OVER (PARTITION BY i.stack_id) AS n,
           row_number() OVER (PARTITION BY i.stack_id ORDER BY (i.rating > 0) DESC, i.rating DESC, coalesce(m.mean_score, 0) DESC, i.date_taken DESC, i.key DESC) AS rn
    FROM images i LEFT JOIN means m ON m.image_key = i.key) q WHERE rn = 1),
hidden AS (SELECT i.key FROM images i JOIN reps r USING (stack_id) WHERE i.key <> r.representative_key)"""
TEXTS = """texts AS (
  SELECT d.doc_id AS key, text AS summary, CASE d.doc_id % 5 WHEN 0 THEN '["red","blue"]' WHEN 1 THEN '[]' WHEN 3 THEN 'not json' WHEN 4 THEN '["blue","green"]' END AS dominant_colors,
         CASE d.doc_id % 4 WHEN 0 THEN '["calm"]' WHEN 1 THEN '["calm","dark"]' WHEN 3 THEN 'null' END AS mood_tags, toxic AS has_repetition, 'm' || (d.doc_id % 3) AS model_used,
         CASE WHEN d.doc_id % 9 <> 0 THEN CAST(DATE '2020-01-01' + CAST(d.doc_id % 700 AS INT) AS VARCHAR) END AS described_at
  FROM documents d LEFT JOIN labels USING (doc_id))"""
ALL = f"WITH {SCORES},\n{LENSES},\n{IMAGES},\n{PCT},\n{STACKS},\n{TEXTS}\n"


def sql_round(x: str, digits: int) -> str:
    """DuckDB SQL that rounds a double as the binary value that it is, halves to even, as its formatting does."""
    return f"CAST(format('{{:.{digits}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
