"""Tables in the shared folder of the cluster.

An executor can be lost at any time, so a value that later steps must see
unchanged (row positions, split points) is written once to the folder named by
``spark.checkpoint.dir`` and read back. Reading back also gives Catalyst the
true size of the table, which is what decides whether a join broadcasts it.

All tables of a session share one folder. :func:`released` removes those that
its block wrote, :func:`clear` all of them.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one, gone at exit, only for a local session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tapeloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path not used before, inside the folder of this application."""
    path = f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table this module named, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Remove the tables written inside the block when it ends.

    Results that read them have to be written or collected before.
    """
    start = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[start:]:
            remove(spark, path)
        del _WRITTEN[start:]


def clear(spark: SparkSession) -> None:
    """Remove every table of this session."""
    remove(spark, _session_folder(spark))
    _WRITTEN.clear()


def settle(df: DataFrame, label: str = "rows") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, label: str = "side") -> DataFrame:
    """Settle the small side of a join so that its size is measured, not guessed.

    No broadcast hint is given: below ``spark.sql.autoBroadcastJoinThreshold`` the
    planner broadcasts the settled table, above it the join stays a sort-merge
    join whose skewed partitions adaptive execution splits.
    """
    return settle(df, label)
