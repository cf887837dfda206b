"""Shared storage: intermediate tables that outlive any executor, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only when its bytes, summed over its rows, stay under this.
BROADCAST_BYTES = 32 << 20
#: Rows with whole texts that go to Python at a time where an operator runs the work itself.
TEXT_ROWS = 2000
_FIXED = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset and the master is local, as in tests, a temporary folder is made and set. On a
    cluster it must be set: a folder of one machine would be another on each executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        store, place = files(spark, path)
        store.delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; what is there goes when the driver ends."""
    root = f"{shared_dir(spark)}/citeloom/{spark.sparkContext.applicationId}"
    store, place = files(spark, root)
    if store.mkdirs(place):
        store.deleteOnExit(place)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again; `rows` at a time go through Python.

    Cuts the lineage: what was computed survives the loss of any executor, and every
    later use reads the table rather than computing it again.
    """
    path = scratch_path(df.sparkSession, name)
    with arrow_rows(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores. A table of one file may be one task to read, however much work its rows are afterwards."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            delete(table.sparkSession, folder)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """The bytes of a value in memory, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        size = F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            each = F.transform(c, lambda x: _bytes(x, kind.elementType))
            return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")) + 24
        return size * _FIXED.get(type(kind.elementType), 8) + 24
    return F.lit(max(8, _FIXED.get(type(kind), 8))).cast("long")


def table_bytes(table: DataFrame) -> int:
    """The bytes of all rows, summed over their values."""
    each = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(16).cast("long"))
    return table.agg(F.sum(each)).first()[0] or 0


def small(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`table`, with a broadcast hint if the bytes of its rows are few enough, else as it is.

    The table should be a stored one, for it is read to be measured. Without the hint Spark joins it
    by shuffle, with the same result.
    """
    return F.broadcast(table) if table_bytes(table) <= limit else table


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None = TEXT_ROWS) -> Iterator[None]:
    """So many rows at a time go to Python in what runs inside; the session's setting is put back after.

    Whole texts are some kilobytes each, and every task holds a batch several times over, in the
    JVM and in Python, so the default of 10,000 rows takes memory from the executor for nothing.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        if rows is not None:
            spark.conf.set(name, str(rows))
        yield
    finally:
        spark.conf.set(name, before)
