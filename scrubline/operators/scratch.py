"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_used: set[str] = set()
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """This application's folder inside the one in spark.checkpoint.dir; a local master without it gets a temporary one.

    The folder goes when the application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        root = _local[0]
    path = f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if path not in _used:
        _used.add(path)
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, unless the session has ended."""
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends here. Few rows, where ``rows`` tells, go to few files."""
    if rows is not None:
        df = df.coalesce(max(4, rows // 100_000))
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._written_at)
