"""The driver's tables in the roles of the logical ones; see TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.functions.scalars import exact_round
from shutterlake.operators import scores as S
from shutterlake.operators import stacks as K
from shutterlake.operators.text_index import TextIndex, index_of
from shutterlake.sources.work import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scores of orders by line number, the latest of each.

    They are dealt by order to a given number of partitions, since partitions that
    are merged by their size in a shuffle have millions of rows to sort.
    """
    last = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_extendedprice"))
    excused = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), 1).otherwise(0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, sf_dir, "lineitem").repartition(tasks, "l_orderkey").withColumn("n", F.row_number().over(last)).where("n = 1")
    return rows.select(F.col("l_orderkey").alias("image_key"), F.col("l_linenumber").alias("perspective_slug"), (1 + F.col("l_quantity").cast("int") % 10).alias("score"), excused.alias("not_attempted"), F.col("l_partkey").alias("partkey"))


def perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as lenses, the first four active."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("slug")).distinct().withColumns({"display_name": F.concat(F.lit("Lens "), F.col("slug").cast("string")), "active": F.when(F.col("slug") <= 4, 1).otherwise(0)})


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images; the customer is the stack."""
    color = F.when(F.col("o_orderstatus") == "F", "Red").when(F.col("o_orderstatus") == "O", "green").otherwise("")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("date_taken"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("rating"), color.alias("color_label"), F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0).alias("instagram_posted"), F.col("o_custkey").alias("stack_id"), F.col("o_orderpriority").alias("title"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of active lenses that were given, with percentiles; written once, since histograms and rows both need them."""
    return S.percentiles(written(S.attempted(scores(spark, sf_dir), perspectives(spark, sf_dir)), "population"))


def stack_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, stack_id, representative_key, stack_size)."""
    rows = images(spark, sf_dir)
    active = perspectives(spark, sf_dir).where("active = 1").select(F.col("slug").alias("perspective_slug"))
    mean = scores(spark, sf_dir).join(F.broadcast(active), "perspective_slug", "left_semi").groupBy("image_key").agg(exact_round(F.avg("score"), 6).alias("mean_score"))
    return K.stack_fields(rows, K.representatives(rows.select("stack_id", "key", "rating", "date_taken"), mean))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as descriptions; the toxic label is the repetition flag, unknown where there is none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("has_repetition"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("described_at"), "has_repetition", "n_chars")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as descriptions with lists of colours and moods, some empty, missing or malformed."""
    n = F.col("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("has_repetition"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    colors = F.when(n % 5 == 0, '["red","blue"]').when(n % 5 == 1, "[]").when(n % 5 == 3, "not json").when(n % 5 == 4, '["blue","green"]')
    moods = F.when(n % 4 == 0, '["calm"]').when(n % 4 == 1, '["calm","dark"]').when(n % 4 == 3, "null")
    at = F.when(n % 9 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (n % 700).cast("int")).cast("string"))
    return rows.select(n.alias("key"), F.col("text").alias("summary"), colors.alias("dominant_colors"), moods.alias("mood_tags"), "has_repetition", F.concat(F.lit("m"), (n % 3).cast("string")).alias("model_used"), at.alias("described_at"))


def catalog_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(total): the images of the catalog."""
    return images(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job logs: the user is the job, the type the level."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("level"), "value", "props")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as image vectors; the label is what searches are narrowed by."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of the documents' texts, kept for the table as it is."""
    return index_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"))
