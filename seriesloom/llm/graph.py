"""Connected components of an edge table, by alternating large and small stars.

Every step is a minimum per vertex and a join back, so a hub that a third of all edges touch is pre-aggregated and, in the
join, split by the adaptive skew join (for which the minima are stored first: else the join would keep the aggregate's
partitioning, and a hub in one task). Edges are written to the shared folder each round, and the round before is deleted;
nothing but two numbers a round reaches the driver. A component of n vertices settles in some log(n) squared rounds; the
bound on rounds is far beyond that and an error, not a cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, dropped, hinted

#: Vertices (two keys of at most 16 bytes each) up to which their minima are broadcast.
BROADCAST_ROWS = 200_000


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(node, root) for each vertex of an edge other than a loop; root is the smallest vertex of its component."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e, "edges")
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = cut(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        least = hinted(first, BROADCAST_ROWS)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        large = cut(large, "large")
        second = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        least = hinted(second, BROADCAST_ROWS)
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        was, e = e, cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "small")
        dropped(was, first, second, large)
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
