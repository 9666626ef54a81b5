"""Shared helpers: the shared folder, written intermediates, text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storepulse.sources.tables import shuffles_removed

#: The six ASCII white-space characters, as a Java and DuckDB regular expression.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, as in tests, a folder beside the warehouse is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/llm"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts lineage).

    The shuffle files of this are removed when it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Delete the files of ``written``, which nothing reads any more."""
    files, spark = df.inputFiles(), df.sparkSession
    if files:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def on_workers_path(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def give_back() -> None:
    """Give freed memory back to the system, where the C library can (glibc)."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, task, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package on the workers' path.

    A Python worker waits for further tasks when one is done; it keeps no freed memory then."""
    on_workers_path(df.sparkSession)

    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of a string column; text ``i`` is ``bytes[starts[i]:starts[i+1]]``.

    Null texts have no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[starts[0]:starts[-1]] if len(starts) else whole[:0], starts - (starts[0] if len(starts) else 0)


def slices(batches, max_bytes: int, text: str = "text"):
    """Arrow batches cut so that the texts of one hold about ``max_bytes`` (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(utf8_buffer(batch.column(text))[1])
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix finaliser)."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
