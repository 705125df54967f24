"""Shape of data and index: distinct words by level, sizes of files and labels, records by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..sources.storage import listing
from .evaluate import deviation, mean

#: Edges of the file size histogram, in blocks.
SIZE_EDGES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.5, 2.0)


def distinct_words(words: DataFrame, cfg: IndexConfig, approximate: bool = False) -> DataFrame:
    """(level, words): distinct prefixes at each level, in one pass."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    flat = words.select("word").distinct() if not approximate else words
    rows = flat.select("word", F.explode(F.sequence(F.lit(1), F.lit(cfg.bits))).alias("level"))
    return rows.groupBy("level").agg(count(F.substring("word", F.lit(1), F.col("level") * cfg.digits)).alias("words"))


def summary(rows: DataFrame, column: str) -> DataFrame:
    """(n, total, largest, smallest, mean, deviation) of a column; zeros for no rows."""
    zero = F.lit(0.0)
    c = F.col(column).cast("double")
    out = rows.select(c.alias("x"))
    return out.agg(F.count("*").alias("n"), F.coalesce(F.sum("x"), zero).alias("total"), F.coalesce(F.max("x"), zero).alias("largest"), F.coalesce(F.min("x"), zero).alias("smallest"), mean("x").alias("mean"), deviation("x").alias("deviation"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, mb) of the data files of a folder that are not empty."""
    rows = [(p, n / 1024 / 1024) for p, n in listing(spark, path, empty=False)]
    return spark.createDataFrame(rows, "path string, mb double")


def blocks(sizes: DataFrame, block_mb: float) -> DataFrame:
    """Storage blocks that the files take."""
    return sizes.agg(F.coalesce(F.sum(F.ceil(F.col("mb") / block_mb)), F.lit(0)).cast("long").alias("blocks"))


def size_histogram(rows: DataFrame, column: str, block: float) -> DataFrame:
    """(bin, low, n): how many values lie in each of the fixed bins, as multiples of ``block``; bins without values are absent."""
    edges = F.array(*(F.lit(e) for e in SIZE_EDGES))
    share = F.col(column).cast("double") / block
    bin_ = F.size(F.filter(edges, lambda e: e <= share))
    low = F.when(bin_ == 0, 0.0).otherwise(F.get(edges, bin_ - 1))
    return rows.select(bin_.alias("bin"), low.alias("low")).groupBy("bin", "low").agg(F.count("*").alias("n"))


def equal_histogram(rows: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, n): equal-width bins from the least to the greatest value, which has a bin of its own; one bin if all are equal."""
    x = F.col(column).cast("double")
    edge = rows.agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
    low, high = F.lit(edge.low).cast("double"), F.lit(edge.high).cast("double")
    bin_ = F.when(high == low, 0).otherwise(F.floor(F.try_divide(x - low, high - low) * bins)).cast("int")
    return rows.select(bin_.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def partition_records(records: DataFrame) -> DataFrame:
    """(partitions, mean, deviation) of the records by pid."""
    return records.groupBy("pid").agg(F.count("*").alias("n")).agg(F.count("*").alias("partitions"), mean("n").alias("mean"), deviation("n").alias("deviation"))


def node_numbers(nodes: DataFrame) -> DataFrame:
    """(pid, internal, terminal) of the local trees; the root of a tree counts."""
    leaf = F.col("is_leaf").cast("int")
    return nodes.groupBy("pid").agg(F.sum(1 - leaf).alias("internal"), F.sum(leaf).alias("terminal"))


def build_report(spark: SparkSession, path: str, block_mb: float) -> DataFrame:
    """(low, n): files of an index by size, in the fixed bins of blocks."""
    return size_histogram(file_sizes(spark, f"{path}/series"), "mb", block_mb).select("low", "n").orderBy("low")
