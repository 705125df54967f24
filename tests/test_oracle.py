import itertools
import math
import struct

import numpy as np
import pytest
import xxhash

import __spark_entry__
from seriesloom import queries
from seriesloom.functions.breakpoints import breakpoints
from seriesloom.functions.distance import word_of
from seriesloom.operators import envelope

from .oracle import DATA, duck_rows, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    names, expected = duck_rows(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == names
    assert rows(df) == expected


#: Queries of seeded hashes, samples and random words, which SQL cannot give; the tests that hold them against brute force.
BY_TEST = {"s1_random_walks", "t16_bands", "k3_k4_samples", "e0_interval_words", "e5_interval_words"}


def test_all_others_have_a_test_here():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == BY_TEST


def _hash(*keys):
    """The chained 64-bit hash of strings and whole numbers (int: 4 bytes, bool never)."""
    seed = 42
    for k in keys:
        raw = k.encode() if isinstance(k, str) else struct.pack("<i" if isinstance(k, np.int32) else "<q", k)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def _uniform(*keys):
    return ((_hash(*keys) >> 11) + 0.5) / 2**53


def test_walks_equal_brute_force(spark):
    got = {r.series_id: r for r in queries.QUERIES["s1_random_walks"](spark, DATA).collect()}
    assert sorted(got) == list(range(500))
    for i in range(500):
        i32 = np.int32
        steps = [math.sqrt(-2 * math.log(_uniform("r", i32(42), i, i32(j)))) * math.cos(2 * math.pi * _uniform("a", i32(42), i, i32(j))) for j in range(1, 65)]
        v = np.cumsum(steps)
        v = (v - v.mean()) / v.std(ddof=1)
        assert abs(got[i].last - v[-1]) < 2e-6 and abs(got[i].squares - (v * v).sum()) < 2e-6


def test_bands_equal_brute_force(spark):
    got = {r.qid: r for r in queries.QUERIES["t16_bands"](spark, DATA).collect()}
    rows = {r.series_id: np.array(r["values"]) for r in queries.series(spark, DATA).collect()}
    assert sorted(got) == sorted(rows)
    edges = breakpoints(64)
    gap = sorted(b - a for a, b in zip(edges, edges[1:], strict=False))[(len(edges) - 1) // 2]
    i32 = np.int32
    for i, v in rows.items():
        parts = sorted(range(8), key=lambda s: (_uniform(i32(42), "seg", i, i32(s)), s))[:2]
        height = max(_uniform(i32(42), "h", i, i32(s)) for s in parts) * gap
        assert got[i].points == 2 * 7 and abs(got[i].height - height) < 2e-6  # 64 points, a fifth of them, in two bands


def test_samples_are_part_of_the_series(spark):
    rows = {r.series_id for r in queries.series(spark, DATA).select("series_id").collect()}
    got = queries.QUERIES["k3_k4_samples"](spark, DATA).collect()
    assert {r.series_id for r in got} < rows and {r.share for r in got} == {0.5}
    assert got == queries.QUERIES["k3_k4_samples"](spark, DATA).collect()


@pytest.mark.parametrize("order", [0, 5])
def test_random_words_equal_brute_force(spark, order):
    got = {}
    for r in queries.QUERIES[f"e{order}_interval_words"](spark, DATA).collect():
        got.setdefault(r.qid, []).append((r.position, r.word))
    bands = queries.bands(spark, DATA).collect()
    assert len(got) == len(bands)
    for b in bands:
        ranges = envelope.symbol_ranges(np.array(b.lower), np.array(b.upper), queries.NARROW)
        every = {word_of(c, queries.NARROW) for c in itertools.product(*ranges)}
        own = [w for _, w in sorted(got[b.qid])]
        assert len(own) == len(set(own)) == min(6, len(every)) and set(own) <= every


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
