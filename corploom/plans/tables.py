"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from corploom.errors import ConfigurationError

_own: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a fresh one only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or next((at for session, at in _own if session is spark), None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("set spark.checkpoint.dir to a folder that all executors share: a folder of one machine would lose tables")
        named = f"file://{tempfile.mkdtemp(prefix='corploom-')}"
        _own.append((spark, named))
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table; after the session has stopped there is nothing left to ask."""
    if spark.sparkContext._jsc is None:
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - at exit the JVM may be gone
        return


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` from a table written now: lineage ends, and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table of a DataFrame from `written` that nothing reads any more."""
    remove(df.sparkSession, df.written_to)
