"""What the operators of this subpackage share: the cluster's shared folder, written cuts, Arrow slices."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cuts import remove, run_folder, shared_folder, spread  # noqa: F401  # run_folder and remove for the pipeline

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None

#: Bytes of text that one vectorised step handles at a time; bounds a Python worker's memory.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """URI of a new folder that the driver and all executors see: in ``spark.checkpoint.dir``, or in the folder of the run (``run_folder``)."""
    return f"{shared_folder(spark)}/seekwell/{uuid.uuid4().hex}"


def mounted(uri: str) -> str:
    """The path under which every machine sees the shared folder ``uri``."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"this operator writes plain files, so it needs a shared folder mounted on every machine; got {uri}")
    return unquote(parts.path)


def cut(df: DataFrame, name: str = "cut", folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (or another) and read it back: a lineage cut that survives lost executors.

    Cuts stay until the folder of their run goes: see ``run_folder`` of sources/cuts.py."""
    path = f"{folder or shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A plain string array; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def give_back() -> None:
    """Returns freed memory to the system, so that a worker's size follows what it holds."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about ``most`` text bytes (one longer text is a batch of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        begin, size = 0, 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield batch.slice(begin, i - begin)
                give_back()
                begin, size = i, 0
            size += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)
            give_back()


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts, by a scan."""
    return df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def documents(spark: SparkSession, sf_dir: str, stable: bool = False) -> DataFrame:
    """The table, dealt over all cores where it has fewer file splits than the cluster has cores.

    Rows of a shuffle come in another order each time they're read; an operator that needs the same order twice asks for a ``stable``
    table, and one that was dealt (a small one, by definition) is written first."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dealt = spread(found)
    return cut(dealt, "dealt") if stable and dealt is not found else dealt
