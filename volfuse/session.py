"""Session settings the operators rely on, and tables staged between pipeline steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []
_local_root: str | None = None


def use_utc(spark: SparkSession) -> SparkSession:
    """Naive times are UTC everywhere, so the session zone has to be UTC too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def require_utc(df: DataFrame) -> None:
    """Grid positions are counted in UTC; another zone would shift or merge hours without a trace."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone is {zone!r}; call use_utc(spark) first")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    On a cluster the setting is needed and must not lie in a machine's folder for temporary files. A local
    master without it, as in tests, gets a private folder.
    """
    global _local_root
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.master.startswith("local"):
        if not folder and _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="volfuse-")
            atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
        return (folder or _local_root).rstrip("/")
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    refuse_temporary(spark, folder)
    return folder.rstrip("/")


def refuse_temporary(spark: SparkSession, folder: str) -> None:
    """Raise if ``folder`` is one of a single machine: other executors would not see what is written there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    place = path.toUri().getPath()
    if files.getScheme() == "file" and place.startswith(("/tmp/", "/var/tmp/", tempfile.gettempdir() + "/")):
        raise RuntimeError(f"spark.checkpoint.dir is {folder!r}, a machine's temporary folder")


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/volfuse/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a result is read more than once: the lineage is cut, later readers prune columns
    and rows at the scan, and the join planner sees the size of what was written.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_all(**tables: DataFrame) -> list[DataFrame]:
    """Stage tables that do not depend on each other side by side."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(lambda item: stage(item[1], item[0]), tables.items()))


def clear_stages(spark: SparkSession) -> None:
    """Delete the tables this process staged."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _staged:
        target = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        target.getFileSystem(conf).delete(target, True)
