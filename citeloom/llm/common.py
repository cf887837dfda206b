"""What the operators share besides storage: columns, and memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.storage import BROADCAST_BYTES, TEXT_ROWS, arrow_rows, delete, files, forget, scratch_path, shared_dir, small, stored, table_bytes

__all__ = ["BROADCAST_BYTES", "TEXT_ROWS", "arrow_rows", "delete", "files", "forget", "scratch_path", "shared_dir", "small", "stored", "table_bytes"]


def trim() -> None:
    """Gives memory that this process no longer uses back to the system.

    Python workers live on between stages, and executors count what they keep.
    """
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(work: Callable) -> Callable:
    """`work` for mapInArrow, with trim() at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    return run


def trimmed_group(work: Callable) -> Callable:
    """`work` for applyInArrow with a key or for a co-group, with trim() after each group."""

    def run(first, second):
        out = work(first, second)
        trim()
        return out

    return run


def trimmed_batches(work: Callable) -> Callable:
    """`work` for applyInArrow with a key, a table to batches, with trim() after each group."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(key, pa.Table.from_batches(list(batches)))
        trim()

    return run


def text_column(docs: DataFrame, name: str = "text"):
    """The column as a string, null as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def fresh(docs: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column is called that."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
