"""``python -m seriesloom.cli {generate|build|label|query|evaluate} --config FILE ...``"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from .config import IndexConfig, LabelConfig, QueryConfig, WalkConfig, describe, from_properties, read_properties
from .operators import evaluate, labels, search, stats
from .plans import index as indexes
from .sources import storage, walks

log = logging.getLogger("seriesloom")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="seriesloom", description="Similarity search over collections of series.")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name, needs in {"generate": ("root",), "build": ("series", "index"), "label": ("series", "labels"), "query": ("index", "labels"), "evaluate": ("series",)}.items():
        verb = verbs.add_parser(name)
        verb.add_argument("--config", help="key=value lines; a line with # is a comment")
        for n in needs:
            verb.add_argument(f"--{n}", required=True)
        if name in ("label", "query"):
            verb.add_argument("--kind", choices=("exact", "knn", "range"), default=["knn"], nargs="+" if name == "label" else 1)
    opts = parser.parse_args(args)
    logging.basicConfig(format="%(asctime)s %(message)s", level=logging.INFO)
    values = read_properties(opts.config) if opts.config else {}
    if "log" in values:  # a file besides the console, appended to
        handler = logging.FileHandler(values["log"])
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    spark = SparkSession.builder.appName("seriesloom").getOrCreate()
    cfg, ask, make = (from_properties(kind, values) for kind in (IndexConfig, QueryConfig, LabelConfig))
    if opts.verb == "generate":
        walk = from_properties(WalkConfig, values)
        log.info("%s\nwritten to %s", describe(walk), walks.generate(spark, walk, opts.root))
    elif opts.verb == "build":
        log.info("%s", describe(cfg))
        built = indexes.build(storage.read_series(spark, opts.series), opts.index, cfg)
        log.info("%d partitions; %s", built.tree.partitions, stats.summary(stats.file_sizes(spark, f"{opts.index}/series"), "mb").first())
        for r in stats.build_report(spark, opts.index, cfg.block_mb).collect():  # a row per bin
            log.info("%s", r)
    elif opts.verb == "label":
        storage.require(spark, series=opts.series)
        series = storage.read_series(spark, opts.series)
        for kind in opts.kind:
            place = opts.labels if len(opts.kind) == 1 else f"{opts.labels}/{kind}"
            if kind == "exact":
                storage.save_labels(labels.exact_labels(series, make, cfg.length), place)
                continue
            picked = series.orderBy("series_id").limit(make.count * (50 if kind == "knn" else 1)).selectExpr("series_id as qid", "values")
            made = search.each_block(picked, cfg.length, lambda qs, f=labels.knn_labels if kind == "knn" else labels.range_labels: f(series, qs, make))
            storage.save_labels(made.join(picked, "qid").select("qid", "values", "neighbours").orderBy("qid").limit(make.count), place)
    elif opts.verb == "query":
        storage.require(spark, index=opts.index, labels=opts.labels)
        log.info("%s", run_queries(spark, opts.kind[0], opts.index, opts.labels, ask).first())
    else:
        stats.distinct_words(indexes.tag(storage.read_series(spark, opts.series), cfg), cfg).orderBy("level").show()


def run_queries(spark: SparkSession, kind: str, index_path: str, label_path: str, ask: QueryConfig):
    """Answer a labelled query set and report on the answers."""
    index, known = indexes.open_index(spark, index_path), storage.read_labels(spark, label_path)
    began = time.time()
    if kind == "exact":
        found = storage.materialise(search.exact_match(index, known.select("qid", "values"), ask.bloom), "exact")
        return evaluate.exact_report(known.select("qid", "expected"), found, time.time() - began)
    queries = search.queries_of(known.select("qid", "values"), index.cfg.length)
    if kind == "knn":
        found = storage.materialise(search.knn(index, queries, ask.k, ask.knn_type, True, max_words=ask.max_words, order=ask.word_order, seed=ask.seed, min_partitions=ask.min_partitions, max_partitions=ask.max_partitions), "knn")
        return evaluate.knn_report(labels.flat(known), found, time.time() - began)
    if kind == "range":
        found = storage.materialise(search.range_search(index, queries, ask.radius), "range")
        return evaluate.range_report(labels.flat(labels.within(known, ask.radius)), found, search.range_report(index, queries, ask.radius), time.time() - began)
    raise ValueError("only exact, knn and range queries are supported")


if __name__ == "__main__":
    main()
