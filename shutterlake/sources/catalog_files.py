"""External catalogs (SQLite files) as a Spark data source, read-only.

``spark.dataSource.register(CatalogFiles)`` and then
``spark.read.format("catalog_files").option("table", t).option("key", k).load(folder)``
gives the rows of table t of every file of a folder. A file is read in ranges of
its integer key, each a partition of about ``rows`` keys. Comparisons that Spark
pushes down go into the SQL of each range, and ranges whose keys a comparison
rules out are not read at all (needs ``spark.sql.python.filterPushdown.enabled``).
Only the columns of the schema that is given are asked for.

The folder must be one that driver and executors see. Files are opened read-only
and never changed. :func:`write` makes such files from a DataFrame.
"""

from __future__ import annotations

import os
import re
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

#: Ending of catalog files, keys of a partition, and rows of a batch.
ENDING, ROWS, BATCH = ".lrcat", 1 << 17, 1 << 14
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_TYPES = {"INTEGER": T.LongType(), "INT": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _files(folder: str) -> list[str]:
    folder = re.sub(r"^file:/*", "/", folder)
    return [folder] if os.path.isfile(folder) else sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(ENDING))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(folder: str, words: tuple[str, ...] = ()) -> list[str]:
    """The tables of a catalog's first file, those with one of the words if any are given."""
    with _open(_files(folder)[0]) as db:
        found = [n for (n,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
    return [n for n in found if not words or re.search("|".join(words), n, re.I)]


def columns(folder: str, table: str) -> T.StructType:
    """The columns of a table by its first file's declarations; what is declared otherwise is text."""
    with _open(_files(folder)[0]) as db:
        found = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    if not found:
        raise ValueError(f"no table {table}")
    return T.StructType([T.StructField(name, _TYPES.get(kind.upper(), T.StringType())) for _, name, kind, *_ in found])


@dataclass
class KeyRange(InputPartition):
    """Rows of one file with keys from ``low`` to ``high``."""

    path: str
    low: int
    high: int


class CatalogReader(DataSourceReader):
    """Reads key ranges of files with the comparisons that Spark pushed down."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.folder, self.table = options["path"], options["table"]
        self.key, self.rows = options.get("key", "id_local"), int(options.get("rows", ROWS))
        self.schema = schema
        self.where: list[tuple[str, str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep the comparisons that SQL makes alike; the others are left to Spark."""
        plain = {f.name for f in self.schema.fields if isinstance(f.dataType, T.LongType | T.DoubleType)}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in plain and type(f) in _SIGNS and f.value is not None:
                self.where.append((name, f"{_quoted(name)} {_SIGNS[type(f)]} ?", [f.value]))
            elif name in plain and isinstance(f, In) and all(v is not None for v in f.value):
                self.where.append((name, f"{_quoted(name)} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif name and isinstance(f, IsNotNull):
                self.where.append((name, f"{_quoted(name)} IS NOT NULL", []))
            else:
                yield f

    def partitions(self) -> list[KeyRange]:
        """Ranges of keys that the pushed comparisons leave; each file is asked for its ends, and each range for one row."""
        out, key = [], _quoted(self.key)
        own = [(sql, values) for name, sql, values in self.where if name == self.key]
        for path in _files(self.folder):
            with _open(path) as db:
                low, high = db.execute(f"SELECT min({key}), max({key}) FROM {_quoted(self.table)}").fetchone()
                at = low
                while low is not None and at <= high:
                    end = min(high, at + self.rows - 1)
                    test = " AND ".join([f"{key} BETWEEN ? AND ?", *(sql for sql, _ in own)])
                    if db.execute(f"SELECT 1 FROM {_quoted(self.table)} WHERE {test} LIMIT 1", [at, end, *(v for _, vs in own for v in vs)]).fetchone():
                        out.append(KeyRange(path, at, end))
                    at = end + 1
        return out or [KeyRange("", 0, -1)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = to_arrow_schema(self.schema)
        names = ", ".join(_quoted(f.name) for f in self.schema.fields)
        test = " AND ".join([f"{_quoted(self.key)} BETWEEN ? AND ?", *(sql for _, sql, _ in self.where)])
        with _open(partition.path) as db:
            rows = db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE {test}", [partition.low, partition.high, *(v for *_, vs in self.where for v in vs)])
            while some := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


class CatalogFiles(DataSource):
    """The source ``catalog_files``; options path, table, key and rows."""

    @classmethod
    def name(cls) -> str:
        return "catalog_files"

    def schema(self) -> T.StructType:
        return columns(self.options["path"], self.options["table"])

    def reader(self, schema: T.StructType) -> CatalogReader:
        return CatalogReader(self.options, schema)


def read(spark: SparkSession, folder: str, table: str, key: str = "id_local", rows: int = ROWS, schema: T.StructType | str | None = None) -> DataFrame:
    """A table of the catalogs in a folder, or of one file; ``schema`` names the columns wanted."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogFiles)
    reader = spark.read.format("catalog_files").option("table", table).option("key", key).option("rows", rows)
    return (reader.schema(schema) if schema is not None else reader).load(folder)


def write(df: DataFrame, folder: str, table: str, key: str, files: int = 4) -> None:
    """``df`` as ``files`` catalog files, by ranges of its integer key; a file appears whole, by a rename."""
    names = [f.name for f in df.schema.fields]
    kinds = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.BinaryType: "BLOB"}
    declared = ", ".join(f"{_quoted(f.name)} {kinds.get(type(f.dataType), 'TEXT')}{' PRIMARY KEY' if f.name == key else ''}" for f in df.schema.fields)
    insert = f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(names))})"

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, staged = None, os.path.join(folder, f"staged-{uuid.uuid4().hex}")
        for batch in batches:
            if db is None and batch.num_rows:
                os.makedirs(folder, exist_ok=True)
                db = sqlite3.connect(staged)
                db.execute(f"CREATE TABLE {_quoted(table)} ({declared})")
            if batch.num_rows:
                db.executemany(insert, zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if db is not None:
            db.commit()
            db.close()
            os.rename(staged, os.path.join(folder, f"{uuid.uuid4().hex}{ENDING}"))
            yield pa.RecordBatch.from_arrays([pa.array([staged])], names=["path"])

    df.repartitionByRange(files, key).mapInArrow(one, "path string").count()
