"""The folder that driver and executors share, and files written there by tasks."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below the session's spark.checkpoint.dir, or below its warehouse where it names none; removed at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/.staging"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    atexit.register(_remove, store, target)  # both outlive the session
    return path


def _remove(store, target) -> None:
    from py4j.protocol import Py4JError

    try:
        store.delete(target, True)
    except (Py4JError, OSError):  # the JVM has gone before
        return


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: made once, and there for every later stage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain(path: str) -> str:
    """A mounted folder's path for Python; a URI of another store is refused."""
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{path} is not a mounted folder")
    return path


def write_file(path: str, data: bytes) -> None:
    """Write a file at once: a task that runs twice leaves the same file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(data)
    os.replace(own, path)
