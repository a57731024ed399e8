"""Reading and writing the logical tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shutterlake.functions.scalars import optional_marker
from shutterlake.functions.udfs import first_body_line
from shutterlake.schema import TABLES


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A logical table from Parquet, with its fixed schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def write(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """A snapshot of a logical table. Write to a folder that is not the one being read."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields]).write.mode(mode).parquet(f"{folder}/{name}")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 1, low: int = 0, high: int = 0) -> DataFrame:
    """A table of an external catalog, in ranges of its key where one is given; needs the database's JDBC driver."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key:
        reader = reader.option("partitionColumn", key).option("numPartitions", partitions).option("lowerBound", low).option("upperBound", high)
    return reader.load()


def tables_like(spark: SparkSession, words: tuple[str, ...] = ()) -> list[str]:
    """Names of the session's tables, those with one of the words if any are given."""
    names = sorted(t.name for t in spark.catalog.listTables())
    return [n for n in names if not words or re.search("|".join(words), n, re.I)]


def describe(df: DataFrame) -> DataFrame:
    """(position, name, type, nullable) of the columns."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def export_json(df: DataFrame, folder: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(folder)


def export_schema(df: DataFrame, folder: str) -> None:
    """The schema of ``df`` as one JSON text."""
    df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def read_schema(spark: SparkSession, folder: str) -> StructType:
    """A schema that :func:`export_schema` wrote."""
    return StructType.fromJson(json.loads(spark.read.text(folder, wholetext=True).first()["value"]))


def export_csv(df: DataFrame, folder: str) -> bool:
    """Rows as CSV with a header; nothing is written for no rows."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").csv(folder, header=True)
    return True


def export_then_drop(df: DataFrame, folder: str) -> int:
    """Rows of a retired table as JSON; the count read back is compared before the caller drops it."""
    before = df.count()
    export_json(df, folder)
    after = df.sparkSession.read.schema(df.schema).json(folder).count()
    if before != after:
        raise RuntimeError(f"{before} rows, but {after} were exported")
    return after


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Perspective rows from a folder of markdown prompts."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select("value", F.input_file_name().alias("path"))
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return files.select(name.alias("slug"), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))).alias("display_name"), first_body_line("value").alias("description"), F.col("value").alias("prompt_markdown"), F.lit(1).cast("long").alias("active"), optional_marker(F.col("value")).cast("long").alias("optional"), F.concat(name, F.lit(".md")).alias("source_filename")).orderBy("slug")


def seeded(perspectives: DataFrame, folder: str) -> DataFrame:
    """The table as it is; where it has no rows, the folder's prompts in its columns (null where a prompt has none).

    The folder is not read otherwise: once seeded, the table decides. Ids count
    from 1 by file name, and both times are now.
    """
    if not perspectives.isEmpty():
        return perspectives
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    # a folder of prompts is a handful of rows
    numbered = F.row_number().over(Window.orderBy("source_filename"))
    prompts = read_prompts(perspectives.sparkSession, folder).withColumns({"id": numbered, "created_at": now, "updated_at": now})
    return prompts.select(*[(F.col(f.name) if f.name in prompts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in perspectives.schema.fields])


def read_image_files(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,dng,png}") -> DataFrame:
    """(path, modificationTime, length, content) of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
