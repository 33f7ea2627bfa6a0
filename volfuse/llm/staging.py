"""Tables written once to the folder that all executors share, to cut lineage and to be read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[tempfile.TemporaryDirectory] = []
_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a private folder only where a local master has no such setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        if not _local:
            _local.append(tempfile.TemporaryDirectory(prefix="volfuse-"))
            atexit.register(_local[0].cleanup)
        folder = _local[0].name
    path = f"{folder.rstrip('/')}/volfuse-llm/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear_stages(spark: SparkSession) -> None:
    """Delete what this process wrote to the shared folder; results that read it must be written by then."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        target = jvm.org.apache.hadoop.fs.Path(_written.pop())
        target.getFileSystem(conf).delete(target, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
