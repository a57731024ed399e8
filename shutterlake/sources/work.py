"""Work tables and kept indexes in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: the lineage ends there, and sizes are exact."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def _file(spark: SparkSession, path: str):
    """The path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    found, files = _file(spark, path)
    return files.exists(found)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    found, files = _file(spark, path)
    files.delete(found, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written`."""
    for table in tables:
        path = getattr(table, "_work_path", None)
        if path:
            delete(table.sparkSession, path)


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a file or folder; false if that failed, as where ``new`` is there."""
    found, files = _file(spark, old)
    target, _ = _file(spark, new)
    files.mkdirs(target.getParent())
    return not files.exists(target) and files.rename(found, target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder."""
    found, files = _file(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(found)) if files.exists(found) else []


def size(spark: SparkSession, path: str) -> int:
    """The bytes of a file or folder, 0 if it is not there."""
    found, files = _file(spark, path)
    return files.getContentSummary(found).getLength() if files.exists(found) else 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file; fails if it is there."""
    found, files = _file(spark, path)
    out = files.create(found, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    found, files = _file(spark, path)
    opened = files.open(found)
    try:
        return bytes(opened.readAllBytes()).decode()
    finally:
        opened.close()


def fingerprint(df: DataFrame, *knobs: object) -> str | None:
    """A name for what ``df`` reads and computes: its plan, and path, size and time of each input file; None if it reads no files."""
    spark = df.sparkSession
    paths = sorted(df.inputFiles())
    if not paths:
        return None
    digest = hashlib.sha256(repr(knobs).encode())
    digest.update(str(df.semanticHash()).encode())
    digest.update(df._jdf.queryExecution().optimizedPlan().canonicalized().toString().encode())
    for path in paths:
        found, files = _file(spark, path)
        status = files.getFileStatus(found)
        digest.update(f"{path}|{status.getLen()}|{status.getModificationTime()}".encode())
    return digest.hexdigest()[:32]
