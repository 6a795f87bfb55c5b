"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import threading

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import scratch

#: A word is a run of anything but space and U+0009..U+000D (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"
#: Python works on at most so many bytes of text at a time.
BLOCK_BYTES = 8 << 20


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, qualified with its file system's scheme; it goes when the driver's JVM ends."""
    return scratch(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    written().append(path)
    return spark.read.schema(df.schema).parquet(path)


def fewer(rows: DataFrame) -> DataFrame:
    """Narrow rows of a light plan, in an eighth of the shuffle's partitions where Spark doesn't join small ones by their size itself: they would make very many small files."""
    conf = rows.sparkSession.conf
    if all(conf.get(f"spark.sql.adaptive.{name}", "true") == "true" for name in ("enabled", "coalescePartitions.enabled")):
        return rows
    return rows.coalesce(max(8, int(conf.get("spark.sql.shuffle.partitions")) // 8))


_tables = threading.local()


def written() -> list[str]:
    """Paths of the temporary tables that this thread has written, oldest first."""
    if not hasattr(_tables, "paths"):
        _tables.paths = []
    return _tables.paths


def forget(spark: SparkSession, since: int) -> None:
    """Delete the tables that followed the first ``since``, all but the newest.

    For a step whose result has just been written: what led to it is not needed
    any more, and at scale would fill the folder.
    """
    paths = written()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths[since:-1]:
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(conf).delete(folder, True)
    del paths[since:-1]


def text_blocks(batch: pa.RecordBatch, column: int = 1):
    """Slices of an Arrow batch with about ``BLOCK_BYTES`` of text each (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
        release()


def release() -> None:
    """Give freed memory back to the system: an executor's workers share its memory with the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of ``values``, empty segments included."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def bound(value: Column, result) -> Column:
    """``result(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), result), 0)
