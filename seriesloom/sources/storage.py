"""Tables and files of an index: scratch folders, paths, existence, sizes, bytes, labels, manifests.

Paths may be of any file system that Spark's session reaches; all calls go through Hadoop's API on the driver. A build is
written under a temporary name and renamed when it is whole, and a manifest in it says what it holds, so a path either has
a complete index or none.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import logging
import shutil
import tempfile
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger("seriesloom")

SERIES = "series_id long, values array<double>"
INTERVALS = "qid long, lower array<double>, upper array<double>"
LABELS = "qid long, values array<double>, neighbours array<struct<dist: double, series_id: long>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share, below ``spark.checkpoint.dir``; a local one if that is unset and all runs on
    one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, local, ignore_errors=True)  # this process's own; a cluster's folder is left alone
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Compute once, through a table in the shared folder."""
    out = scratch(df.sparkSession, name)
    df.write.parquet(out)
    back = df.sparkSession.read.schema(df.schema).parquet(out)
    back._path = out
    return back


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was anything to delete."""
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot rename {old} to {new}")


def listing(spark: SparkSession, path: str, empty: bool = True) -> list[tuple[str, int]]:
    """(path, bytes) of the data files below a folder, without markers; ``empty=False`` drops files of no bytes."""
    fs, p = _fs(spark, path)
    out, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if not name.startswith(("_", ".")) and (empty or f.getLen()):
            out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def stamp(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and times of the files below a path: another one when they change."""
    fs, p = _fs(spark, path)
    files, seen = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def partition_path(root: str, pid: int) -> str:
    """Folder of a partition's series."""
    if pid < 0:
        raise ValueError("a partition number is not negative")
    return f"{root.rstrip('/')}/series/pid={pid}"


def read_series(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(SERIES).parquet(*paths)


def save_labels(labels: DataFrame, path: str) -> None:
    labels.coalesce(2).write.mode("overwrite").parquet(path)


def read_labels(spark: SparkSession, path: str, at_most: int | None = None) -> DataFrame:
    """Labels, in order of qid if cut to a number."""
    rows = spark.read.parquet(path)
    return rows.orderBy("qid").limit(at_most) if at_most is not None else rows


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    write_bytes(spark, f"{path}/manifest.json", json.dumps(content, indent=1, sort_keys=True).encode())


def read_manifest(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/manifest.json"):
        raise FileNotFoundError(f"no complete index at {path}")
    return json.loads(read_bytes(spark, f"{path}/manifest.json"))


def require(spark: SparkSession, **paths: str) -> None:
    """Fail before planning if an input is missing."""
    missing = [f"{name} ({path})" for name, path in paths.items() if not exists(spark, path)]
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))


def from_embeddings(rows: DataFrame) -> DataFrame:
    """The ``embeddings`` table as z-normalised series; vectors without one (constant, null) are left out."""
    from ..functions.representation import z_normalise

    return rows.select(F.col("vec_id").alias("series_id"), z_normalise(F.col("embedding")).alias("values")).where("values is not null")


def from_events(events: DataFrame, days: int | None = 30, start: str | None = "2024-01-01") -> DataFrame:
    """A series of daily sums per user from the ``events`` table; days without events count 0. Without ``start`` and ``days``
    the range is that of the data; events outside a given range are left out and counted by :func:`outside`. A day's values are
    added one after another in order of the events' identifiers, as the last bits of a sum, and with them symbols, depend on the order."""
    if start is None or days is None:
        seen = events.agg(F.min(F.to_date("ts")).alias("low"), F.max(F.to_date("ts")).alias("high")).first()
        start = start or str(seen.low)
        days = days or (0 if seen.high is None else (seen.high - date.fromisoformat(start)).days + 1)
    day = F.datediff(F.to_date("ts"), F.lit(start))
    order = [c for c in ("event_id", "ts", "value") if c in events.columns]
    so_far = Window.partitionBy("user_id", "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.where(day.between(0, days - 1)).select("user_id", day.alias("day"), *order)
    running = rows.select("user_id", "day", F.sum("value").over(so_far).alias("s"), F.row_number().over(so_far).alias("n"))
    sums = running.groupBy("user_id", "day").agg(F.max_by("s", "n").alias("s"))
    by_day = F.map_from_entries(F.collect_list(F.struct("day", "s")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda d: F.coalesce(F.col("m")[d], F.lit(0.0)))
    return sums.groupBy("user_id").agg(by_day.alias("m")).select(F.col("user_id").alias("series_id"), filled.alias("values"))


def outside(events: DataFrame, days: int = 30, start: str = "2024-01-01") -> int:
    """Events that :func:`from_events` leaves out for this range, those without a time included."""
    day = F.datediff(F.to_date("ts"), F.lit(start))
    return events.where(~F.coalesce(day.between(0, days - 1), F.lit(False))).count()
