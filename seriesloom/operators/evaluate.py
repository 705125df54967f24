"""How good answers are: recall, error ratio, and reports of one row.

Truth and answers are rows (qid, rank, dist, series_id); an empty table gives reports of zeros rather than a division by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, recall): the share of each query's true neighbours that were found."""
    t = truth.groupBy("qid").agg(F.collect_set("series_id").alias("t"))
    f = found.groupBy("qid").agg(F.collect_set("series_id").alias("f"))
    both = F.size(F.array_intersect("t", F.coalesce("f", F.array().cast("array<bigint>"))))
    return t.join(f, "qid", "left").select("qid", (both / F.size("t")).alias("recall"))


def error_ratio(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, error_ratio): mean over ranks that both have of found distance over true distance; 1 where the truth is 0."""
    t = truth.select("qid", "rank", F.col("dist").alias("true_dist"))
    ratio = F.when(F.col("true_dist") == 0, F.lit(1.0)).otherwise(F.col("dist") / F.col("true_dist"))
    return found.join(t, ["qid", "rank"]).groupBy("qid").agg(F.avg(ratio).alias("error_ratio"))


def mean(c: str) -> Column:
    """Mean, 0 of nothing."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def deviation(c: str) -> Column:
    """Population deviation, 0 of nothing."""
    return F.coalesce(F.stddev_pop(c), F.lit(0.0))


def least_thresholds(words: DataFrame) -> DataFrame:
    """(qid, pid, threshold): of a query's words (qid, word, pid, threshold) in one partition, the least threshold."""
    return words.groupBy("qid", "pid").agg(F.min("threshold").alias("threshold"))


def exact_report(labels: DataFrame, found: DataFrame, seconds: float = 0.0) -> DataFrame:
    """(queries, correct_rate, block_rate, ms_per_query) from labels (qid, expected) and answers (qid, found, blocks)."""
    rows = labels.join(found, "qid", "left")
    right = (F.coalesce("found", F.lit(False)) == F.col("expected")).cast("double")
    out = rows.select(right.alias("right"), F.coalesce("blocks", F.lit(0)).alias("blocks"))
    n = F.count("*")
    return out.agg(n.alias("queries"), mean("right").alias("correct_rate"), mean("blocks").alias("block_rate"), F.when(n > 0, F.round(1000.0 * seconds / n)).otherwise(0.0).cast("long").alias("ms_per_query"))


def knn_report(truth: DataFrame, found: DataFrame, seconds: float = 0.0) -> DataFrame:
    """(queries, recall, error_ratio, ms_per_query)."""
    rows = recall(truth, found).join(error_ratio(truth, found), "qid", "left")
    n = F.count("*")
    return rows.agg(n.alias("queries"), mean("recall").alias("recall"), mean("error_ratio").alias("error_ratio"), F.when(n > 0, F.round(1000.0 * seconds / n)).otherwise(0.0).cast("long").alias("ms_per_query"))


def range_report(truth: DataFrame, found: DataFrame, visits: DataFrame, seconds: float = 0.0) -> DataFrame:
    """Recall (min, max, mean, deviation), records and blocks a query, visited nodes, time; ``visits`` from the search's report."""
    per = recall(truth, found).join(found.groupBy("qid").agg(F.count("*").alias("records")), "qid", "left").join(visits, "qid", "left").fillna(0)
    n = F.count("*")
    return per.agg(
        n.alias("queries"), F.coalesce(F.min("recall"), F.lit(0.0)).alias("min_recall"), F.coalesce(F.max("recall"), F.lit(0.0)).alias("max_recall"), mean("recall").alias("mean_recall"), deviation("recall").alias("sd_recall"),
        mean("records").alias("records"), mean("blocks").alias("blocks"), mean("internal_nodes").alias("internal_nodes"), mean("terminal_nodes").alias("terminal_nodes"),
        F.when(n > 0, F.round(1000.0 * seconds / n)).otherwise(0.0).cast("long").alias("ms_per_query"),
    )
