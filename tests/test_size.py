"""What only larger tables show: identifiers that meet, plans of many queries, sums in another order."""

import datetime
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom import queries
from seriesloom.operators import search
from seriesloom.plans import index as indexes
from seriesloom.sources import storage

from .oracle import DATA, duck_rows, rows


@pytest.fixture(scope="module")
def wide_ids(spark):
    """The test vectors, and other ones whose identifiers are larger by 100,000."""
    own = spark.read.parquet(f"{DATA}/embeddings.parquet")
    other = own.withColumn("vec_id", F.col("vec_id") + 100000).withColumn("embedding", F.transform("embedding", lambda x, i: x + 0.01 * (i % 3)).cast("array<float>"))
    root = storage.scratch(spark, "wide")
    own.unionByName(other).write.parquet(f"{root}/embeddings.parquet")
    return root


def same(spark, name, root):
    names, expected = duck_rows(queries.ORACLE_SQL[name], {"embeddings": f"{root.removeprefix('file://')}/embeddings.parquet/*.parquet"})
    got = queries.QUERIES[name](spark, root)
    assert sorted(got.columns) == names and rows(got) == expected and expected


def test_q1_probes_of_one_qid(spark, wide_ids):
    same(spark, "q1_exact_match", wide_ids)


def test_a12_probes_of_one_qid(spark, wide_ids):
    same(spark, "a12_exact_report", wide_ids)


def test_q2_probes_of_one_qid(spark, wide_ids):
    same(spark, "q2_exact_match_bloom", wide_ids)


@pytest.fixture(scope="module")
def many(spark):
    """An index of partitions of few series, and 3,000 queries."""
    data = queries.series(spark, DATA)
    index = indexes.build(storage.materialise(data, "series"), storage.scratch(spark, "index"), queries.NARROW)
    first = [np.array(r["values"]) for r in data.orderBy("series_id").limit(30).collect()]
    return index, [search.Query(i, first[i % 30], first[i % 30]) for i in range(3000)]


def held(f):
    """MB that the driver's Python had at most, and what ``f`` gave."""
    tracemalloc.start()
    out = f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6, out


def test_i12_partitions_are_found_in_tasks(many):
    index, asked = many
    peak, found = held(lambda: search.partitions_within(index, asked, queries.RADIUS))
    assert peak < 6
    got = {}
    for r in found.where("qid < 60").collect():
        got.setdefault(r.qid, []).append(r.pid)
    assert {q: sorted(p) for q, p in got.items()} == {q: list(p) for q, p in search.plan_range(index, asked[:60], queries.RADIUS).items()}
    assert found.count() == 100 * sum(len(p) for p in search.plan_range(index, asked[:30], queries.RADIUS).values())


def test_q11_visits_are_counted_in_tasks(many):
    index, asked = many
    peak, report = held(lambda: search.range_report(index, asked, queries.RADIUS))
    assert peak < 6
    got = {r.qid: r for r in report.collect()}
    plan = search.plan_range(index, asked[:30], queries.RADIUS)
    assert sorted(got) == list(range(3000)) and all(got[q].blocks == len(plan[q % 30]) for q in got)


def test_a12_range_search_keeps_no_plan_of_pairs(many):
    index, asked = many
    peak, found = held(lambda: search.range_search(index, asked, 100.0))
    assert peak < 2.5
    assert found.count() == 3000 * index.series().count()


def test_t7_sums_follow_the_order_of_events(spark):
    """Values whose sum, 500 or the double below it, depends on the order; files hold the events backwards."""
    cents = np.random.default_rng(3).integers(1, 20000, (20000, 2))
    triples = [(a / 100, b / 100, (50000 - a - b) / 100) for a, b in cents.tolist()]
    odd = [(a, b, c) for a, b, c in triples if c > 0 and min((a + b) + c, (c + b) + a) < max((a + b) + c, (c + b) + a) == 500.0][:50]
    assert len(odd) == 50
    at = datetime.datetime(2024, 1, 2, tzinfo=datetime.UTC)
    events = [(3 * u + i, at, u, x) for u, t in enumerate(odd) for i, x in enumerate(t)]
    made = lambda part: spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, value double").coalesce(1)
    root = storage.scratch(spark, "events")
    made(events).write.parquet(f"{root}/ordered")
    for i in (2, 1, 0):
        made([e for e in events if e[0] % 3 == i]).write.mode("append").parquet(f"{root}/events.parquet")
    made(sorted(events, reverse=True)).write.parquet(f"{root}/back/events.parquet")
    _, expected = duck_rows(queries.ORACLE_SQL["t7_t13_words_and_back"], {"events": f"{root.removeprefix('file://')}/ordered/*.parquet"})
    for where in (root, f"{root}/back"):
        assert rows(queries.QUERIES["t7_t13_words_and_back"](spark, where)) == expected
