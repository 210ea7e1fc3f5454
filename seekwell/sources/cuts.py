"""Lineage cuts for plans of many stages."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_RUN = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder of this thread's run, inside ``run_folder``; else spark.checkpoint.dir; only where that is unset and the master is local (one
    machine, tests) a temporary folder."""
    if folders := getattr(_RUN, "folders", None):
        return folders[-1]
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"file://{tempfile.gettempdir()}/seekwell-{os.getpid()}"
    return root.rstrip("/")


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """What this thread writes to the shared folder inside (cuts, token files, indexes) goes to one new folder of it, which is removed at the
    end, after a fault too. Results that read from there must have been written elsewhere or collected by then. Runs may be nested."""
    folder = f"{shared_folder(spark)}/runs/{uuid.uuid4().hex}"
    _RUN.folders = [*getattr(_RUN, "folders", ()), folder]
    try:
        yield folder
    finally:
        _RUN.folders = _RUN.folders[:-1]
        remove(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later plans begin at its rows and read only the columns
    they use."""
    path = f"{shared_folder(df.sparkSession)}/cuts/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """A table of fewer file splits than the cluster has cores is dealt over all of them; any larger one is left as it is. Dealt by a ``key``, rows
    needn't be sorted first, and what is grouped by that key later isn't dealt again."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)
