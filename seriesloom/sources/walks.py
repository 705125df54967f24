"""Synthetic series: seeded random walks, and interval queries with bands around them.

Every value follows from (seed, id, position) through a hash, so the result does not depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig, WalkConfig
from ..functions.breakpoints import breakpoints
from ..functions.representation import running_sum, z_normalise


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from a hash of its keys."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)


def normal(*keys: Column) -> Column:
    """A standard normal number from a hash of its keys (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(F.lit("r"), *keys))) * F.cos(2 * math.pi * uniform(F.lit("a"), *keys))


def random_walks(spark: SparkSession, cfg: WalkConfig) -> DataFrame:
    """(series_id, values): z-normalised running sums of normal steps."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(cfg.length)), lambda i: normal(F.lit(cfg.seed), F.col("id"), i))
    return spark.range(0, cfg.count, 1, cfg.partitions()).select(F.col("id").alias("series_id"), z_normalise(running_sum(steps)).alias("values"))


def with_bands(series: DataFrame, cfg: WalkConfig) -> DataFrame:
    """(qid, lower, upper): in each of ``band_segments`` segments a band of ``length * band_share / band_segments`` points at
    a random place, centred on the value at its start, up to ``band_height`` median bin widths high; elsewhere both are the series."""
    index = IndexConfig(length=cfg.length, segments=cfg.segments, cardinality=cfg.cardinality)
    wide = math.ceil(cfg.length * cfg.band_share / cfg.band_segments)
    if cfg.band_segments > index.word_length or wide > index.step:
        raise ValueError("bands do not fit: fewer segments or a smaller share is needed")
    bounds = breakpoints(cfg.cardinality)
    gaps = sorted(b - a for a, b in zip(bounds, bounds[1:])) or [1.0]
    height = cfg.band_height * gaps[len(gaps) // 2]
    sid = F.col("series_id")
    chosen = F.slice(F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(index.word_length - 1)), lambda s: F.struct(uniform(F.lit(cfg.seed), F.lit("seg"), sid, s).alias("r"), s.alias("s")))), lambda x: x.s), 1, cfg.band_segments)

    def band(s: Column) -> Column:
        room = F.least(F.lit(index.step), F.lit(cfg.length) - s * index.step) - wide
        start = s * index.step + F.floor(uniform(F.lit(cfg.seed), F.lit("at"), sid, s) * (F.greatest(room, F.lit(0)) + 1)).cast("int")
        half = uniform(F.lit(cfg.seed), F.lit("h"), sid, s) * height / 2
        return F.struct(start.alias("start"), half.alias("half"), F.element_at("values", start + 1).alias("mid"))

    rows = series.withColumn("bands", F.transform(chosen, band))

    def side(sign: int) -> Column:
        def point(x: Column, i: Column) -> Column:
            own = F.filter("bands", lambda b: (i >= b.start) & (i < b.start + wide))
            return F.when(F.size(own) > 0, own[0]["mid"] + sign * own[0]["half"]).otherwise(x)

        return F.transform("values", point)

    return rows.select(sid.alias("qid"), side(-1).alias("lower"), side(1).alias("upper"))


def generate(spark: SparkSession, cfg: WalkConfig, root: str) -> str:
    """Write walks (and, with bands, the intervals beside them); returns the path, which says what it holds."""
    path, walks = cfg.path(root), random_walks(spark, cfg)
    walks.write.mode("errorifexists").parquet(path)
    if cfg.bands:
        with_bands(spark.read.schema(walks.schema).parquet(path), cfg).write.mode("errorifexists").parquet(f"{path}-bands")
    return path
