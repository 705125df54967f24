"""Tables and files in the folder that driver and executors share.

Stages that must be computed once (or whose lineage must end) are written as Parquet below ``spark.checkpoint.dir``.
Python workers that write files of their own formats use :class:`Store`, which goes through ``pyarrow.fs`` and so
reaches local, HDFS and object-store paths alike. A task writes under a fresh name and reports that name in its result
rows; only reported names are ever read, so retried or speculative tasks leave unread files and never a torn one.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: the cluster's own, or, where one machine does everything and none is set, a local one that
    goes when the process ends. Executors on other machines would not see that, so there a missing setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/") if "://" in root or root.startswith("file:") else f"file://{root.rstrip('/')}"


def fresh(spark: SparkSession, name: str) -> str:
    """URI of a folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is executed inside sends Arrow batches of at most 8 MB or 1,000 rows to Python workers, so that long texts stay
    small in both; the session has its own settings again afterwards."""
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage ended, safe against lost executors."""
    spark, out = df.sparkSession, fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(out)
    back = spark.read.schema(df.schema).parquet(out)
    back._cut_path = out
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete what :func:`cut` wrote for these tables, which nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(t.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


#: Bytes (as text) up to which a table is broadcast, however few its rows are.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (already materialised by :func:`cut`) has at most so many rows and bytes, the check before a broadcast."""
    if df.limit(rows + 1).count() > rows:
        return False
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary") or "<" in kind]
    if not wide:
        return True
    size = lambda c, kind: F.octet_length(c) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(c)))
    kinds = dict(df.dtypes)
    held = df.agg(F.sum(sum((F.coalesce(size(c, kinds[c]), F.lit(0)).cast("long") for c in wide), F.lit(0))).alias("n")).first().n
    return (held or 0) <= most_bytes


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is :func:`small`; otherwise unchanged, and Spark shuffles it."""
    return F.broadcast(df) if small(df, rows) else df


class Store:
    """Files below one URI, for use inside tasks."""

    def __init__(self, uri: str):
        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def create(self, name: str):
        path = f"{self.root}/{name}"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        return self.fs.open_output_stream(path, compression=None)  # names may end in .gz

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")


def release() -> None:
    """Give what this Python worker has freed back to the system; workers outlive their tasks and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def settle(spark: SparkSession) -> None:
    """Give back what the driver has freed: its JVM's heap and the classes of earlier plans, which go in a full collection
    only, and what its Python holds."""
    gc.collect()
    spark._jvm.System.gc()
    release()


def unique_name(prefix: str, suffix: str) -> str:
    """A file name for this task attempt."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{prefix}-{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex[:12]}{suffix}"
