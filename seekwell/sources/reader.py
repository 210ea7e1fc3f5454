"""The distributed reader. Executors must see the root (one machine, or a shared mount)."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FILES, ISSUES, SNAPSHOTS
from .walk import Policy, Walk, global_rules, walk

#: Bytes of a file, bytes that are searched for control characters.
FILE_BYTES, SNIFF_BYTES = 16 << 20, 8192
CONTROL = bytes([*range(0x09), 0x0B, *range(0x0E, 0x20), 0x7F])


def is_binary(content: Column) -> Column:
    """S6 for a binary column: a control byte (tab, LF, FF, CR aside) in the first 8192."""
    return F.decode(F.substring(content, 1, SNIFF_BYTES), "ISO-8859-1").rlike("[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]")


def snapshot_status(content: Column) -> Column:
    """struct(status, reason) of a binary column."""
    return F.struct(
        F.when(is_binary(content) | ~F.is_valid_utf8(content.cast("string")), "excluded").otherwise("ok").alias("status"),
        F.when(is_binary(content), "binary").when(~F.is_valid_utf8(content.cast("string")), "invalid_utf8").alias("reason"),
    )


def read_one(root: str, path: str) -> tuple[str | None, str | None, int, str, str | None]:
    """(source, content_hash, bytes, status, reason) of one file."""
    full = f"{root}/{path}"
    try:
        info = os.lstat(full)
    except OSError:
        return None, None, 0, "issue", "changed"
    if not stat.S_ISREG(info.st_mode):
        return None, None, 0, "excluded", "special"
    if info.st_size > FILE_BYTES:
        return None, None, info.st_size, "issue", "resource_limit"
    try:
        with open(full, "rb") as f:
            data = f.read()
    except OSError:
        return None, None, info.st_size, "issue", "unreadable"
    if len(data[:SNIFF_BYTES].translate(None, CONTROL)) != len(data[:SNIFF_BYTES]):
        return None, None, len(data), "excluded", "binary"
    try:
        return data.decode(), hashlib.sha256(data).hexdigest(), len(data), "ok", None
    except UnicodeDecodeError:
        return None, None, len(data), "excluded", "invalid_utf8"


def listing(spark: SparkSession, root: str, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame, Walk]:  # noqa: B008
    """The eligible files and the walk's issues, as tables."""
    found = walk(root, policy, global_rules())
    return spark.createDataFrame(found.files, FILES), spark.createDataFrame(found.issues, ISSUES), found


def snapshots(files: DataFrame, root: str, n_partitions: int | None = None) -> DataFrame:
    """SNAPSHOTS of (path): each file is read once, in parallel."""
    root = os.path.abspath(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *read_one(root, p)) for p in b["path"]]
            yield pd.DataFrame(rows, columns=["path", "source", "content_hash", "bytes", "status", "reason"])

    n = n_partitions or files.sparkSession.sparkContext.defaultParallelism
    return files.select("path").repartition(n, "path").mapInPandas(read, SNAPSHOTS)
