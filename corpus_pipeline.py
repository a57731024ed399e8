"""The corpus pipeline: documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet in the shared folder and read again as the next stage's ``docs``; all
but the last return the columns of ``documents``.

In every stage rows with a null id are documents of their own, rows that share an
id are one document (what drops one drops all of them), an empty table gives an
empty table, and further columns stay, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import bpe, decontaminate, langid, lines, minhash
from shutterlake.llm.common import discard, read_table, written
from shutterlake.llm.queries import BPE_RANKS, LANGUAGE_PIECES


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told.

    Null texts and those without a letter go, and those that the likeliest language
    explains no better than a vocabulary of equal pieces does: texts in languages
    that were not learned, and letters struck at random.
    """
    model = langid.learn(docs, LANGUAGE_PIECES)
    told = langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("fit") > 0))
    return told.select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; a document of which nothing but white space is left goes.

    Null texts stay. ``n_chars`` follows the text where lines went.
    """
    cut = lines.dedup(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    left = cut.where(~F.coalesce(emptied, F.lit(False)))
    left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Null and empty texts and null ids are near to nothing and stay. The ids that go
    are written, so that their exact size decides whether the texts are shuffled.
    """
    found = minhash.near_duplicates(docs, width=5, percent=80)
    gone = written(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    discard(found)
    return docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; one with a null id is told by its text."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    found = decontaminate.contained(docs, benchmark).select("doc_id").distinct()
    left = docs.join(found, "doc_id", "left_anti")
    unnamed = docs.where("doc_id is null and text is not null").select(F.xxhash64("text").alias("doc_id"), "text")
    if not unnamed.isEmpty():
        pairs = decontaminate.contained(unnamed, benchmark).select("doc_id").distinct()
        texts = unnamed.join(pairs, "doc_id", "left_semi").select(F.col("text").alias("found_text")).distinct()
        left = left.join(texts, left["doc_id"].isNull() & (left["text"] == texts["found_text"]), "left_anti")
    return left.select(*_columns(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, as a count and digests; a null text has none. Every row stays."""
    coded = bpe.encode(docs.select("doc_id", "text"), BPE_RANKS, public_tokenizers.PATTERN, ids_bytes="raw")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("raw", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), BPE_RANKS), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: The stages learn, hash and encode, which SQL cannot express; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
