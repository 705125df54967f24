"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``queries``: seconds (the better of two runs) of operators over the test tables, and of searches over an index of generated random
walks, which is built once (``index_build``) and large enough for its bounds to matter. ``index``: recall of the answers against
brute force, and partitions opened over partitions there are, a query on average.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seriesloom import queries
from seriesloom.config import IndexConfig, WalkConfig
from seriesloom.operators import evaluate, search
from seriesloom.plans import index as indexes
from seriesloom.sources import storage, walks

TABLES = ("t8_words", "a2_layer_counts", "k1_knn_brute", "f2_range_brute", "e1_interval_words", "i6_partition_plan")
WALKS, POINTS, ASKED, K, RADIUS = 200_000, 64, 2_000, 10, 1.5
CFG = IndexConfig(length=POINTS, segments=8, cardinality=64, max_records=4_000, leaf_threshold=500, sampling=True, block_sampling=False, bloom=True)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, make, runs: int = 2):
        taken = []
        for _ in range(runs):  # the first compiles
            began = time.time()
            out = make()
            if out is not None and hasattr(out, "write"):
                out.write.format("noop").mode("overwrite").save()
            taken.append(time.time() - began)
        seconds[name] = round(min(taken), 3)
        return out

    for name in TABLES:
        timed(name, lambda name=name: queries.QUERIES[name](spark, sf_dir))

    with tempfile.TemporaryDirectory() as folder:
        rows = storage.materialise(walks.random_walks(spark, WalkConfig(count=WALKS, length=POINTS, block_mb=8.0)), "walks")
        built = timed("index_build", lambda: indexes.build(rows, f"file://{folder}/{time.time()}", CFG), runs=1)
        ask = rows.where(f"series_id % {WALKS // ASKED} = 0").selectExpr("series_id as qid", f"transform(values, (x, i) -> x + 0.02 * ((i * 7) % 5 - 2)) as values")
        asked = search.queries_of(ask, POINTS)
        truth = storage.materialise(timed("walks_knn_brute", lambda: search.brute_knn(rows, asked, K)), "truth")
        hits = storage.materialise(timed("walks_range_brute", lambda: search.brute_range(rows, asked, RADIUS)), "hits")
        index = {}
        opened = lambda plan: round(sum(len(own) for own in plan.values()) / len(plan) / (built.tree.partitions + 1), 4)
        for kind, name in enumerate(("target_node", "home_partition", "siblings")):
            found = storage.materialise(timed(f"walks_knn_{name}", lambda kind=kind: search.knn(built, asked, K, kind)), "found")
            r = evaluate.knn_report(truth, found).first()
            index[name] = {"recall": round(r.recall, 4), "error_ratio": round(r.error_ratio, 4), "opened": opened(search.plan_knn(built, asked, K, kind))}
        found = storage.materialise(timed("walks_range", lambda: search.range_search(built, asked, RADIUS)), "found")
        index["range"] = {"recall": round(evaluate.recall(hits, found).agg(F.avg("recall")).first()[0] or 0, 4), "opened": opened(search.plan_range(built, asked, RADIUS)), "hits": hits.count()}
        own = rows.where(f"series_id % {WALKS // ASKED} = 0")
        probes = storage.materialise(own.selectExpr("series_id as qid", "values").unionByName(ask.selectExpr("qid + 1000000 as qid", "values")), "probes")
        timed("walks_exact", lambda: search.exact_match(built, probes))
        found = timed("walks_exact_bloom", lambda: search.exact_match(built, probes, bloom=True))
        r = evaluate.exact_report(probes.select("qid", (F.col("qid") < 1_000_000).alias("expected")), found).first()
        index["exact_bloom"] = {"correct": r.correct_rate, "blocks": r.block_rate}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "index": index, "partitions": built.tree.partitions}))


if __name__ == "__main__":
    main()
