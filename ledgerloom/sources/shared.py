"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

_folders: list[str] = []
LOCAL_FALLBACK = "file:///tmp/checkpoints/ledgerloom"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the context's checkpoint folder, without a trailing slash.

    Where a local session has neither (tests, a laptop), it is a folder under
    ``/tmp/checkpoints``; on a cluster that is an error, since executors
    wouldn't see each other's files.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_FALLBACK
    return found.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has; :func:`delete_folders` knows of it."""
    path = f"{shared_dir(spark)}/ledgerloom-{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def delete_folders(spark: SparkSession, *paths: str) -> None:
    """Delete these folders of :func:`work_folder`, or all; DataFrames that read them are of no more use."""
    for text in paths or tuple(_folders):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _folders.remove(text)
