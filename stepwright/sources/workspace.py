"""The shared folder for checkpoints and tables a job writes for itself."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _is_local(master: str) -> bool:
    """Whether executors run inside the driver's process."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`, on a cluster one that all executors share.

    Without a scheme it is a path of the default file system; on one of files it is
    taken to be mounted on all machines, like one of `file:`. Only a local session that
    names none gets a temporary folder; on a cluster a machine-local folder would be
    lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not _is_local(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="stepwright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    elif not _is_local(context.master):
        # executors have working folders of their own, so a path without a scheme is made a full one here
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        folder = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_used: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; `remove_written` clears it."""
    _used.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _used[-1]


def remove_written(spark: SparkSession) -> int:
    """Delete what this process wrote to the shared folder, and say how many paths that were.

    To be called once the results that read from there are done with.
    """
    removed = 0
    while _used:
        path = spark._jvm.org.apache.hadoop.fs.Path(_used.pop())
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a large table that several jobs read; each then scans only its columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
