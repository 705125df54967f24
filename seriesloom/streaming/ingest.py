"""Adding series to an index as they arrive (beyond what batch builds do).

New series are tagged with word and partition by the standing plan, in a stream without state, and each micro-batch is
stored beside the index, under its number, so a batch that is replayed after a failure overwrites itself. Searches see them
after :func:`refresh`, which builds the grown index whole (partitions, node counts, filters, the tree with its new counts)
under another name and then puts it in the old one's place, so that a path always has a complete index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import filters
from ..plans import planner
from ..plans.index import Index, local_nodes, open_index, tag
from ..sources import storage


def tagged(stream: DataFrame, index: Index) -> DataFrame:
    """(series_id, values, word, pid) of arriving series."""
    return planner.assign(tag(stream, index.cfg).select("series_id", "values", "word"), index.tree)


def ingest(stream: DataFrame, index: Index, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Store a stream of (series_id, values) for ``index``."""
    root = f"{index.path}.arrived"

    def write(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions("pid", "word").write.mode("overwrite").partitionBy("pid").parquet(f"{root}/batch={number}")

    writer = tagged(stream, index).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def refresh(index: Index) -> Index:
    """The index with all series that have arrived."""
    spark, root, cfg = index.spark, f"{index.path}.arrived", index.cfg
    if not storage.exists(spark, root):
        return index
    new = spark.read.option("basePath", root).parquet(f"{root}/*").select("series_id", "values", "word", "pid")
    temp, old = f"{index.path}.refreshing", f"{index.path}.old"
    storage.delete(spark, temp)
    everything = index.series().select("series_id", "values", "word", "pid").unionByName(new)
    everything.repartitionById(index.tree.partitions + 1, F.col("pid")).sortWithinPartitions("word", "series_id").write.partitionBy("pid").parquet(f"{temp}/series")
    raw = spark.read.parquet(f"{temp}/series")
    local_nodes(raw.select("pid", "word"), cfg).repartition("pid").sortWithinPartitions("pid", "prefix").write.parquet(f"{temp}/nodes")
    if cfg.bloom:
        filters.bloom_table(raw.select("pid", "word", "values"), cfg).write.partitionBy("pid").parquet(f"{temp}/bloom")
    added = planner.layer_counts(planner.word_counts(new), cfg).select("prefix", F.col("cnt").alias("added"))
    grown = index.tree.table(spark).join(added, "prefix", "left").join(new.agg(F.count("*").alias("all")), F.col("prefix") == "", "left")
    grown = grown.withColumn("est_cnt", F.col("est_cnt") + F.coalesce("added", "all", F.lit(0)))
    grown.select("prefix", "level", "est_cnt", "is_leaf", "pids").coalesce(1).write.parquet(f"{temp}/global")
    storage.write_manifest(spark, temp, storage.read_manifest(spark, index.path))
    storage.delete(spark, old)
    storage.rename(spark, index.path, old)
    storage.rename(spark, temp, index.path)
    storage.delete(spark, root)
    storage.delete(spark, old)
    return open_index(spark, index.path)
