"""What the operators need from a session: this package on the executors' path."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_shipped: set[str] = set()
_local: dict[str, str] = {}
_marked: set[str] = set()
#: Bytes of an Arrow batch: Spark's setting, its default, and what is enough here (a batch is held several times over).
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers, once for each application.

    Arrow batches are made smaller unless the session sets their size (that
    setting is the one thing of the caller's session that is changed).  Spark's file server carries the archive, so executors share no folder with
    the driver.
    """
    context = spark.sparkContext
    if spark.conf.get(ARROW_BYTES[0], None) == ARROW_BYTES[1]:
        spark.conf.set(ARROW_BYTES[0], ARROW_BYTES[2])
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="lamina-")) / "lamina.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"lamina/{p.relative_to(root).as_posix()}")
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def release() -> None:
    """Give freed memory back to the system: an executor's workers share its memory with the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors that the session names in ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of this machine,
    once for each application (the session's settings stay as they are); on a
    cluster that is an error, as every machine would have a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lamina-")
        base = _local[context.applicationId]
    return base.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, given: dict[str, str]):
    """The session's settings are ``given`` within the block, and after it what they were.

    Blocks of several threads of one session may leave each other's settings behind.
    """
    before = dict(spark.conf.getAll)
    try:
        for name, value in given.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name in given:
            spark.conf.set(name, before[name]) if name in before else spark.conf.unset(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a temporary table in the shared folder, qualified with its file system's scheme.

    The application's temporary tables are deleted when the driver's JVM ends.
    """
    context = spark.sparkContext
    jvm, root = context._jvm, f"{shared_dir(spark)}/lamina/{context.applicationId}"
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(context._jsc.hadoopConfiguration())
    if root not in _marked:
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _marked.add(root)
    return fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{root}/{uuid.uuid4().hex}/{name}")).toString()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
