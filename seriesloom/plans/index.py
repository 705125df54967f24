"""Building and opening an index.

Layout below a path: ``series/pid=<n>`` (word, series_id, values; sorted by word, so row groups skip by prefix), ``global``
(the planned tree), ``nodes`` (the local tree of each partition), ``bloom`` (a filter per partition), ``manifest.json``.

Plan: words are computed once per series. A sample of files or records gives prefix counts in one aggregate; the plan is made
on the driver; one shuffle by partition id brings each partition's records to one task, which writes one sorted file. Local
nodes are counts of prefixes; nothing holds a partition in memory.
"""

from __future__ import annotations

import math
import random
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions.representation import series_word, valid
from ..operators import filters
from ..sources import storage
from . import planner


@dataclass
class Index:
    spark: SparkSession
    path: str
    cfg: IndexConfig
    tree: planner.GlobalIndex

    def series(self, pids: list[int] | None = None) -> DataFrame:
        """Stored records; a list of partitions becomes a literal partition filter, so others are not opened."""
        rows = self.spark.read.schema("series_id long, values array<double>, word string, pid int").parquet(f"{self.path}/series")
        return rows if pids is None else rows.where(F.col("pid").isin([int(p) for p in pids]))

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes")

    def bloom(self) -> DataFrame:
        return self.spark.read.schema(filters.BLOOM).parquet(f"{self.path}/bloom")


def tag(series: DataFrame, cfg: IndexConfig) -> DataFrame:
    """Series with their word; arrays that are no series of this length are left out (see :func:`rejected`)."""
    return series.where(valid(F.col("values"), cfg.length)).withColumn("word", series_word(F.col("values"), cfg))


def rejected(series: DataFrame, cfg: IndexConfig) -> DataFrame:
    """What :func:`tag` leaves out: wrong length, null, NaN or infinity."""
    return series.where(~F.coalesce(valid(F.col("values"), cfg.length), F.lit(False)))


def sample(series: DataFrame, cfg: IndexConfig) -> tuple[DataFrame, float]:
    """A seeded sample of whole files or of records, and the share of records it stands for."""
    if cfg.fraction >= 1:
        return series, 1.0
    files = sorted(series.inputFiles()) if cfg.block_sampling else []
    if len(files) > 1 and set(series.columns) <= {"series_id", "values"} and _plain(series):
        some = random.Random(cfg.seed).sample(files, math.ceil(len(files) * cfg.fraction))
        return series.sparkSession.read.schema(series.schema).parquet(*some), len(some) / len(files)
    return series.sample(False, cfg.fraction, cfg.seed), cfg.fraction


def _plain(series: DataFrame) -> bool:
    """Whether a table is the rows of its files as they stand: a scan and nothing else. Files of a derived table (filtered,
    computed, joined) do not hold its rows, so of such a table records are sampled."""
    plan = series._jdf.queryExecution().optimizedPlan()
    return plan.children().isEmpty() and plan.nodeName().startswith("LogicalRelation")


def plan_partitions(series: DataFrame, cfg: IndexConfig) -> planner.GlobalIndex:
    """The global tree of a table of series."""
    cfg.require_indexable()
    part, fraction = sample(series, cfg)
    counts = planner.layer_counts(planner.word_counts(tag(part, cfg)), cfg, cfg.capacity * fraction)
    return planner.plan([(r.prefix, r.cnt) for r in counts.select("prefix", "cnt").collect()], cfg, fraction)


def local_nodes(words: DataFrame, cfg: IndexConfig, by: str = "pid") -> DataFrame:
    """(pid, level, prefix, cnt, is_leaf) of each partition's local tree, from (pid, word) rows.

    A tree begins at the first level where the partition has more than one prefix; below, a node exists if its parent has
    more than ``leaf_threshold`` records; a node of at most that many, or of the last level, is a leaf. The root (level 0,
    empty prefix) always exists, and is the leaf if all records share one word.
    """
    counts = words.groupBy(by, "word").agg(F.count("*").alias("cnt"))
    flat = counts.select(by, "word", "cnt", F.explode(F.sequence(F.lit(1), F.lit(cfg.bits))).alias("level"))
    all_ = flat.groupBy(by, "level", F.substring("word", F.lit(1), F.col("level") * cfg.digits).alias("prefix")).agg(F.sum("cnt").alias("cnt"))
    start = all_.groupBy(by, "level").agg(F.count("*").alias("n")).where("n > 1").groupBy(by).agg(F.min("level").alias("start"))
    parents = all_.select(by, (F.col("level") + 1).alias("level"), F.col("prefix").alias("parent"), F.col("cnt").alias("parent_cnt"))
    up = F.substring("prefix", F.lit(1), (F.col("level") - 1) * cfg.digits)
    known = all_.join(start, by).withColumn("parent", up).join(parents, [by, "level", "parent"], "left")
    held = known.where((F.col("level") == F.col("start")) | (F.col("level") > F.col("start")) & (F.col("parent_cnt") > cfg.leaf_threshold))
    inner = held.select(by, "level", "prefix", "cnt", ((F.col("cnt") <= cfg.leaf_threshold) | (F.col("level") == cfg.bits)).alias("is_leaf"))
    roots = counts.groupBy(by).agg(F.sum("cnt").alias("cnt")).join(start, by, "left")
    root = roots.select(by, F.lit(0).alias("level"), F.lit("").alias("prefix"), "cnt", F.col("start").isNull().alias("is_leaf"))
    return root.unionByName(inner)


def build(series: DataFrame, path: str, cfg: IndexConfig, values: bool = True) -> Index:
    """Build below ``path``, or open what is complete there. ``values=False`` keeps words and ids alone."""
    spark = series.sparkSession
    if storage.exists(spark, f"{path}/manifest.json"):
        return open_index(spark, path)
    storage.delete(spark, path)
    tree = plan_partitions(series, cfg)
    temp = f"{path}.building"
    storage.delete(spark, temp)
    kept = ["series_id", "values"] if values else ["series_id"]
    placed = planner.assign(tag(series, cfg).select(*kept, "word"), tree)
    dealt = placed.repartitionById(tree.partitions + 1, F.col("pid")).sortWithinPartitions("word", "series_id")
    dealt.write.partitionBy("pid").parquet(f"{temp}/raw")
    raw = spark.read.parquet(f"{temp}/raw")
    local_nodes(raw.select("pid", "word"), cfg).repartition("pid").sortWithinPartitions("pid", "prefix").write.parquet(f"{temp}/nodes")
    if cfg.bloom:
        if cfg.bloom_features and not values:
            raise ValueError("keys with features need the values, which this index does not keep")
        filters.bloom_table(raw.select("pid", "word", *(["values"] if values else [])), cfg).write.partitionBy("pid").parquet(f"{temp}/bloom")
    storage.rename(spark, f"{temp}/raw", f"{temp}/series")
    tree.table(spark).coalesce(1).write.parquet(f"{temp}/global")
    storage.write_manifest(spark, temp, {"config": asdict(cfg), "partitions": tree.partitions, "values": values})
    storage.rename(spark, temp, path)
    return Index(spark, path, cfg, tree)


def open_index(spark: SparkSession, path: str) -> Index:
    cfg = IndexConfig(**storage.read_manifest(spark, path)["config"])
    return Index(spark, path, cfg, planner.load(spark.read.parquet(f"{path}/global"), cfg))


def with_leaf(index: Index, pids: list[int] | None = None) -> DataFrame:
    """Stored records with the prefix of the local leaf they lie in."""
    leaves = index.nodes().where("is_leaf").select("pid", "level", F.col("prefix").alias("leaf"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(index.cfg.bits))).alias("level")
    words = index.series(pids).select("pid", "word").distinct().select("pid", "word", levels)
    found = words.join(leaves, (words.pid == leaves.pid) & (words.level == leaves.level) & (F.substring("word", F.lit(1), words.level * index.cfg.digits) == F.col("leaf"))).select(words.pid, "word", "leaf")
    return index.series(pids).join(found, ["pid", "word"])


def target_nodes(nodes: DataFrame, queries: DataFrame, k: int, cfg: IndexConfig) -> DataFrame:
    """(qid, pid, target): the deepest node on each query's path (qid, pid, word) with more than k records, else the root."""
    paths = queries.select("qid", "pid", "word", F.explode(F.sequence(F.lit(0), F.lit(cfg.bits))).alias("level"))
    on_path = paths.withColumn("prefix", F.substring("word", F.lit(1), F.col("level") * cfg.digits)).join(nodes.select("pid", "prefix", "cnt"), ["pid", "prefix"])
    deepest = on_path.withColumn("ok", (F.col("level") == 0) | (F.col("cnt") > k)).where("ok")
    return deepest.groupBy("qid", "pid").agg(F.max(F.struct("level", "prefix")).alias("t")).select("qid", "pid", F.col("t.prefix").alias("target"))


