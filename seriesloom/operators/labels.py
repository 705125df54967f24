"""Query sets with known answers, made by reading everything rather than by the index they are to test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LabelConfig, WalkConfig
from ..sources import storage
from ..sources.walks import random_walks
from .search import Query, _search, brute_range, ranked


def exact_labels(series: DataFrame, cfg: LabelConfig, length: int, others: DataFrame | None = None) -> DataFrame:
    """(qid, values, expected): stored series and, from ``others`` or random walks, series that are verified not to be stored."""
    spark = series.sparkSession
    inside = round(cfg.count * cfg.include)
    own = series.orderBy(F.xxhash64("series_id", F.lit(cfg.seed)), "series_id").limit(inside).select("values", F.lit(True).alias("expected"))
    walks = others if others is not None else random_walks(spark, WalkConfig(count=2 * cfg.count + 10, length=length, seed=cfg.seed + 1))
    absent = walks.select("series_id", "values").join(series.select("values"), "values", "left_anti")
    absent = absent.orderBy(F.xxhash64("series_id", F.lit(cfg.seed)), "series_id").limit(cfg.count - inside).select("values", F.lit(False).alias("expected"))
    both = own.unionByName(absent)
    from pyspark.sql import Window

    order = Window.orderBy(F.xxhash64("values", F.lit(cfg.seed)))  # as many rows as labels are asked for
    return both.select((F.row_number().over(order) - 1).cast("long").alias("qid"), "values", "expected")


def range_labels(series: DataFrame, queries: list[Query], cfg: LabelConfig) -> DataFrame:
    """(qid, neighbours): all hits within the radius, for queries with some, but at most ``most``."""
    found = storage.materialise(brute_range(series, queries, cfg.radius), "hits")  # read once, used twice
    fit = found.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n").between(1, cfg.most)).select("qid")
    return neighbours(found.join(fit, "qid", "left_semi"))


def knn_labels(series: DataFrame, queries: list[Query], cfg: LabelConfig) -> DataFrame:
    """(qid, neighbours): the true k nearest of queries with more than k series within the radius: of the k + 1 nearest within
    it, all must be there. No task returns more than k + 1 hits of a query."""
    near = ranked(_search(series, queries, cfg.k + 1, cfg.radius, None), cfg.k + 1, full=True)
    return neighbours(near.where(F.col("rank") <= cfg.k).select("qid", "series_id", "dist"))


def neighbours(found: DataFrame) -> DataFrame:
    return found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("dist", "series_id"))).alias("neighbours"))


def within(labels: DataFrame, radius: float) -> DataFrame:
    """Labels cut to neighbours nearer than the radius (strictly); queries left without any are dropped."""
    return labels.withColumn("neighbours", F.filter("neighbours", lambda x: x.dist < radius)).where(F.size("neighbours") > 0)


def flat(labels: DataFrame) -> DataFrame:
    """(qid, rank, dist, series_id)."""
    return labels.select("qid", F.posexplode("neighbours").alias("rank", "n")).select("qid", (F.col("rank") + 1).alias("rank"), "n.dist", "n.series_id")
