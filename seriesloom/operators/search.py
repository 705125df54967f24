"""Searches over stored series, many queries in one job.

A plan says which partitions (and, below them, which prefixes) each query may find answers in. For the nearest it is made on the
driver from node tables and rides in the tasks' closure with the queries, of which one job takes at most ``MAX_QUERIES``; larger
query sets are answered block by block (:func:`each_block`). Within a radius a query may reach most partitions, so there the driver
knows only which any query reaches, and tasks find the rest from bounds. Stored records are opened by a literal partition filter. In a task, the
bounds from a query to the boxes of a batch's distinct words say which records can be answers (within the radius, or
nearer than the k found so far); distances to these alone are computed by NumPy, and only what can be an answer leaves the
task: at most k rows a query and task, or what lies within the radius. Records that are no series of the queries' length (null, short,
not finite) are passed over.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions.distance import bounds_to, boxes, distances, segment_means, symbols_of, word_of
from ..plans.index import Index, target_nodes
from ..sources import storage
from . import filters
from .envelope import words_of

#: Queries of one job; they and their plan are held by the driver and every task.
MAX_QUERIES = 20_000
#: Probes of exact match (of a few hundred bytes each) up to which they are broadcast.
MAX_PROBES = 100_000
FOUND = "qid long, series_id long, dist double"


@dataclass
class Query:
    """A series (``upper is lower``) or an interval series."""

    qid: int
    lower: np.ndarray
    upper: np.ndarray

    @property
    def scalar(self) -> bool:
        return self.lower is self.upper


def _checked(got: list, columns: list[str], length: int | None) -> list[Query]:
    out = []
    for r in got:
        if "values" in columns:
            lower = upper = np.array(r["values"], float)
        else:
            lower, upper = np.array(r.lower, float), np.array(r.upper, float)
        if length is not None and (lower.shape != (length,) or upper.shape != (length,)):
            raise ValueError(f"query {r.qid} is not of length {length}")
        if not np.isfinite(lower).all() or not np.isfinite(upper).all() or (lower > upper).any():
            raise ValueError(f"query {r.qid} holds a value that is no number, or an empty interval")
        out.append(Query(int(r.qid), lower, upper))
    return sorted(out, key=lambda q: q.qid)


def queries_of(rows: DataFrame, length: int | None = None, limit: int = MAX_QUERIES) -> list[Query]:
    """Queries of one job from (qid, values) or (qid, lower, upper); wrong lengths and values that are no numbers are errors."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"over {limit} queries: answer them block by block (each_block)")
    return _checked(got, rows.columns, length)


def each_block(rows: DataFrame, length: int, answer: Callable[[list[Query]], DataFrame], size: int = MAX_QUERIES) -> DataFrame:
    """``answer`` for query sets of any size, in successive jobs of at most ``size`` queries, whose answers are stored and united."""
    rows = rows.orderBy("qid")
    if rows.limit(size + 1).count() <= size:
        return answer(_checked(rows.collect(), rows.columns, length))
    out, block = None, []
    for r in itertools.chain(rows.toLocalIterator(), [None]):
        if block and (r is None or len(block) == size):
            done = storage.materialise(answer(_checked(block, rows.columns, length)), "answers")
            out, block = done if out is None else out.unionByName(done), []
        if r is not None:
            block.append(r)
    return out


def _means(queries: list[Query], cfg: IndexConfig) -> tuple[np.ndarray, np.ndarray]:
    """Segment means (queries, segments) of the lower and the upper lines."""
    if not queries:
        return np.zeros((0, cfg.word_length)), np.zeros((0, cfg.word_length))
    lower = segment_means(np.stack([q.lower for q in queries]), cfg)
    return lower, lower if all(q.scalar for q in queries) else segment_means(np.stack([q.upper for q in queries]), cfg)


def _whole(part: pa.RecordBatch, length: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of a batch that are series of this length, and their values."""
    sized = np.asarray(pc.fill_null(pc.list_value_length(part.column(1)), -1)) == length
    if not sized.all():
        part = part.filter(pa.array(sized))
    flat = part.column(1).flatten()
    values = flat.to_numpy(zero_copy_only=False).reshape(part.num_rows, length)  # nulls become NaN
    fine = np.isfinite(values).all(1)
    return (part, values) if fine.all() else (part.filter(pa.array(fine)), values[fine])


def _search(rows: DataFrame, queries: list[Query], k: int | None, radius: float | None, plan: dict[int, dict[int, tuple[str, ...]]] | None, strict: bool = False, cfg: IndexConfig | None = None) -> DataFrame:
    """Rows of ``FOUND``. plan: qid -> pid -> prefixes (an empty one: all); None: everything. With ``cfg`` the rows have words,
    and bounds to them are computed first."""
    columns = ["series_id", "values"] + (["pid", "word"] if cfg is not None else [])
    length = len(queries[0].lower) if queries else 0
    low, high = _means(queries, cfg) if cfg is not None else (None, None)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in parts:
            if not queries or not part.num_rows:
                continue
            part, values = _whole(part, length)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            if cfg is not None:
                pids = part.column(2).to_numpy(zero_copy_only=False)
                held, (words, of) = {int(p) for p in np.unique(pids)}, np.unique(np.array(part.column(3).to_pylist(), str), return_inverse=True)
                lo, hi = boxes(words.tolist(), cfg)
            out = []
            for n, q in enumerate(queries):
                at = None
                if cfg is not None:
                    own = plan.get(q.qid, {}) if plan is not None else {}
                    here = held & own.keys()
                    if plan is not None and not here:
                        continue
                    edge = radius if k is None else best[q.qid][0].max() if q.qid in best and len(best[q.qid][0]) >= k else np.inf
                    near = bounds_to(lo, hi, low[n], high[n], cfg) <= edge * (1 + 1e-9) + 1e-9
                    if not near.any():
                        continue
                    mask = np.zeros(part.num_rows, bool) if plan is not None else near[of]
                    for p in here:
                        fit = near if "" in own[p] else near & np.logical_or.reduce([np.char.startswith(words, x) for x in own[p]])
                        mask |= (pids == p) & fit[of]
                    at = np.flatnonzero(mask)
                    if not len(at):
                        continue
                d = distances(values if at is None else values[at], q.lower, q.upper)
                own_ids = ids if at is None else ids[at]
                if radius is not None:
                    near = d < radius if strict else d <= radius
                    d, own_ids = d[near], own_ids[near]
                if k is None:
                    if len(d):
                        out.append((np.full(len(d), q.qid), own_ids, d))
                    continue
                if q.qid in best:
                    d, own_ids = np.concatenate([best[q.qid][0], d]), np.concatenate([best[q.qid][1], own_ids])
                if len(d) > k:
                    edge = np.partition(d, k - 1)[k - 1]
                    d, own_ids = d[keep := d <= edge], own_ids[keep]
                    order = np.lexsort((own_ids, d))[:k]
                    d, own_ids = d[order], own_ids[order]
                best[q.qid] = d, own_ids
            if out:
                yield _batch(out)
        if best:
            yield _batch([(np.full(len(d), q), i, d) for q, (d, i) in best.items()])

    return rows.select(*columns).mapInArrow(run, FOUND)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["qid", "series_id", "dist"])


def ranked(found: DataFrame, k: int, full: bool = False) -> DataFrame:
    """(qid, rank, dist, series_id): the k nearest, ties by series_id; with ``full`` only queries that have k of them."""
    order = Window.partitionBy("qid").orderBy("dist", "series_id")
    out = found.dropDuplicates(["qid", "series_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if full:
        whole = out.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") == k).select("qid")
        out = out.join(whole, "qid", "left_semi")
    return out.select("qid", "rank", "dist", "series_id")


def brute_knn(series: DataFrame, queries: list[Query], k: int) -> DataFrame:
    """Exact nearest neighbours by reading everything."""
    return ranked(_search(series, queries, k, None, None), k)


def brute_range(series: DataFrame, queries: list[Query], radius: float, strict: bool = False) -> DataFrame:
    return _search(series, queries, None, radius, None, strict)


def _words(q: Query, index: Index, max_words: int, order: int, seed: int) -> list[str]:
    cfg = index.cfg
    if q.scalar:
        return [word_of(symbols_of(segment_means(q.lower, cfg), cfg.cardinality), cfg)]
    return words_of(q.lower, q.upper, cfg, max_words, order, seed)


def _used(plan: dict[int, dict[int, tuple[str, ...]]]) -> list[int]:
    return sorted({p for own in plan.values() for p in own})


def plan_knn(index: Index, queries: list[Query], k: int, kind: int, max_words: int = 3, order: int = 0, seed: int = 42, min_partitions: int = 1, max_partitions: int | None = None) -> dict[int, dict[int, tuple[str, ...]]]:
    """Where each query looks. Kind 0: its target node; 1: its home partition; 2: the home's siblings too. With
    ``max_partitions`` at most so many more (of a scalar query only the home if ``min_partitions`` is 1 and there are more).
    An interval query looks at the places of each of its words."""
    tree, plan, homes = index.tree, {}, []
    for q in queries:
        own: dict[int, tuple[str, ...]] = {}
        for w in _words(q, index, max_words, order, seed):
            home = tree.pid(w)
            homes.append((q.qid, home, w))
            own[home] = ("",)
            if kind == 2:
                others = [p for p in tree.siblings(w) if p != home]
                if max_partitions is not None and len(others) + 1 > max_partitions:
                    others = [] if min_partitions == 1 and q.scalar else others[:max_partitions]
                own |= dict.fromkeys(others, ("",))
        plan[q.qid] = own
    if kind == 0:
        spark = index.spark
        asked = spark.createDataFrame([(i, q, p, w) for i, (q, p, w) in enumerate(homes)], "qid long, query long, pid int, word string")
        nodes = index.nodes().where(F.col("pid").isin(sorted({p for _, p, _ in homes})))
        got: dict[int, dict[int, set]] = {}
        for r in target_nodes(nodes, asked, k, index.cfg).join(asked.select("qid", "query"), "qid").collect():
            got.setdefault(r.query, {}).setdefault(r.pid, set()).add(r.target)
        plan = {q: {p: tuple(sorted(t)) for p, t in own.items()} for q, own in got.items()}
    return plan


def knn(index: Index, queries: list[Query], k: int, kind: int = 0, full: bool = False, **options) -> DataFrame:
    """The k nearest among the places of :func:`plan_knn`."""
    plan = plan_knn(index, queries, k, kind, **options)
    return ranked(_search(index.series(_used(plan)), queries, k, None, plan, cfg=index.cfg), k, full)


def plan_range(index: Index, queries: list[Query], radius: float) -> dict[int, dict[int, tuple[str, ...]]]:
    """Partitions whose bound is within the radius, and the overflow; of few queries, as the driver holds queries times partitions."""
    return {q.qid: dict.fromkeys(index.tree.within(lo, hi, radius), ("",)) for q, lo, hi in zip(queries, *_means(queries, index.cfg), strict=True)}


def partitions_within(index: Index, queries: list[Query], radius: float) -> DataFrame:
    """(qid, pid): what :func:`plan_range` gives, found in tasks of some queries each."""
    cfg, (lo, hi, pids), overflow = index.cfg, index.tree.boxes(), index.tree.overflow
    qids, (low, high) = np.array([q.qid for q in queries], np.int64), _means(queries, cfg)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in part.column(0).to_pylist():
                own = np.append(np.unique(pids[bounds_to(lo, hi, low[i], high[i], cfg) <= radius]), overflow)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), qids[i]), pa.int64()), pa.array(own, pa.int32())], ["qid", "pid"])

    return index.spark.range(0, len(qids), 1, max(1, min(len(qids) // 64, 256))).mapInArrow(run, "qid long, pid int")


def range_search(index: Index, queries: list[Query], radius: float, strict: bool = False) -> DataFrame:
    """All (qid, series_id, dist) with ``dist <= radius``; bounds spare partitions that cannot hold any."""
    pids = index.tree.within_any(*_means(queries, index.cfg), radius)
    return _search(index.series(pids), queries, None, radius, None, strict, index.cfg)


def range_report(index: Index, queries: list[Query], radius: float) -> DataFrame:
    """(qid, blocks, internal_nodes, terminal_nodes): partitions read, and local nodes whose path stays within the radius."""
    cfg = index.cfg
    qids, (low, high) = np.array([q.qid for q in queries], np.int64), _means(queries, cfg)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer = np.zeros(len(qids), np.int64), np.zeros(len(qids), np.int64)
        for part in parts:
            lo, hi = boxes(part.column(0).to_pylist(), cfg)
            leaf = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i in range(len(qids)):
                inside = bounds_to(lo, hi, low[i], high[i], cfg) <= radius
                n, leaves = np.count_nonzero(inside), np.count_nonzero(inside & leaf)
                inner[i] += n - leaves
                outer[i] += leaves
        yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(inner), pa.array(outer)], ["qid", "inner", "outer"])

    # bounds grow down a path, so a node within the radius has all its ancestors there, its partition's leaf among them; a root is as near as its partition
    nodes = index.nodes()
    below = nodes.where("level > 0").select("prefix", "is_leaf").mapInArrow(run, "qid long, inner long, outer long").groupBy("qid").agg(F.sum("inner").alias("inner"), F.sum("outer").alias("outer"))
    roots = F.broadcast(nodes.where("level = 0").select("pid", F.col("is_leaf").cast("int").alias("leaf")))  # a row per partition
    own = partitions_within(index, queries, radius).join(roots, "pid", "left").groupBy("qid").agg(F.count("*").cast("int").alias("blocks"), F.sum(1 - F.col("leaf")).alias("stems"), F.sum("leaf").alias("leaves"))
    both = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("int")
    return own.join(below, "qid", "left").select("qid", "blocks", both("stems", "inner").alias("internal_nodes"), both("leaves", "outer").alias("terminal_nodes"))


def exact_match(index: Index, rows: DataFrame, bloom: bool = False) -> DataFrame:
    """(qid, found, blocks) of queries (qid, values): whether a stored series has these very values, and partitions read for it.
    Each row is a query of its own and has a row of the answer, whether or not others bear its qid.

    The probes go to the stored records, by broadcast or (if they are many) as the hashed side of a join, so records are
    streamed past them in place.
    """
    from ..functions.representation import bloom_key, series_word, valid
    from ..plans.planner import assign

    cfg = index.cfg
    if rows.where(~F.coalesce(valid(F.col("values"), cfg.length), F.lit(False))).limit(1).count():
        raise ValueError(f"a query is no series of length {cfg.length}")
    asked = assign(rows.select("qid", F.transform("values", lambda x: x.cast("double")).alias("values")).withColumn("word", series_word(F.col("values"), cfg)), index.tree)
    if bloom:
        probes = asked.withColumn("key", bloom_key(F.col("word"), F.col("values"), cfg.bloom_features))
        asked = filters.might_contain(probes, index.bloom()).withColumn("blocks", F.col("maybe").cast("int")).drop("key", "maybe")
    else:
        asked = asked.withColumn("blocks", F.lit(1))
    asked = storage.materialise(asked.withColumn("probe", F.monotonically_increasing_id()), "probes")
    open_ = asked.where("blocks > 0").select("probe", "pid", "word", "values")
    pids = [r.pid for r in open_.select("pid").distinct().collect()]  # partitions, for the literal filter
    few = open_.limit(MAX_PROBES + 1).count() <= MAX_PROBES
    sought = F.broadcast(open_) if few else open_.hint("shuffle_hash")
    hit = index.series(pids).select("pid", "word", "values").join(sought, ["pid", "word", "values"]).select("probe").distinct().withColumn("found", F.lit(True))
    return asked.join(hit, "probe", "left").select("qid", F.coalesce("found", F.lit(False)).alias("found"), "blocks")
