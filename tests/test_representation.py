import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.config import CARDINALITIES, IndexConfig, LabelConfig, QueryConfig, WalkConfig, describe, from_properties, read_properties, truth
from seriesloom.functions import distance as D
from seriesloom.functions import representation as R
from seriesloom.functions.breakpoints import breakpoints

MEANS = [-1.5, -0.5, 0.0, 0.5, 1.5, 2.0, -2.5, 0.1]


@pytest.mark.parametrize(("c", "syms", "word"), [(4, [0, 1, 2, 2, 3, 3, 0, 2], "3d4c"), (8, [0, 2, 4, 5, 7, 7, 0, 4], "3d4c1c"), (64, [4, 19, 32, 44, 59, 62, 0, 34], "3d4c1c944d48")])
def test_golden_words(spark, c, syms, word):
    cfg = IndexConfig(length=64, segments=8, cardinality=c)
    assert D.symbols_of(np.array(MEANS), c).tolist() == syms
    assert D.word_of(syms, cfg) == word
    assert D.unword(word, cfg).tolist() == syms
    means = F.array(*(F.lit(m) for m in MEANS))
    row = spark.range(1).select(R.symbols(means, c).alias("s"), R.word(F.array(*(F.lit(s) for s in syms)), cfg.bits, cfg.digits).alias("w")).withColumn("back", R.word_symbols(F.col("w"), cfg)).first()
    assert (row.s, row.w, row.back) == (syms, word, syms)


def test_six_segments_go_back(spark):
    cfg = IndexConfig(length=30, segments=6, cardinality=8)
    assert D.word_of([0, 2, 4, 5, 7, 7], cfg) == "0f1307"
    assert spark.range(1).select(R.word_symbols(F.lit("0f1307"), cfg).alias("s")).first().s == [0, 2, 4, 5, 7, 7]


def test_breakpoints():
    assert breakpoints(4) == (-0.67449, 0.0, 0.67449)
    assert breakpoints(8) == (-1.1503, -0.67449, -0.31864, 0.0, 0.31864, 0.67449, 1.1503)
    for c in (2, 4, 8, 16, 32, 64, 128):
        assert breakpoints(c) == breakpoints(2 * c)[1::2]
    for c in CARDINALITIES:
        assert list(breakpoints(c)) == sorted(breakpoints(c)) and len(breakpoints(c)) == c - 1
    with pytest.raises(ValueError, match="no breakpoints"):
        breakpoints(33)


def test_equality_goes_up():
    assert D.symbols_of(np.array([0.0, -0.67449, 0.67449]), 4).tolist() == [2, 1, 3]


def test_golden_bounds(spark):
    cfg = IndexConfig(length=64, segments=8, cardinality=64)
    expected = [0.0, 3.815492, 6.63073, 7.915108, 9.337028, 10.045182]
    nodes = ["3d4c1c944d48"[: 2 * i] for i in range(1, 7)]
    zero = np.zeros(8)
    assert np.round(D.box_bounds(nodes, zero, zero, cfg), 6).tolist() == expected
    zeros = F.array(*(F.lit(0.0) for _ in range(8)))
    rows = spark.createDataFrame([(n,) for n in nodes], "w string").select(F.round(D.node_bound(F.col("w"), zeros, zeros, cfg), 6).alias("b")).collect()
    assert [r.b for r in rows] == expected


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(64, 4), (64, 8), (30, 6), (30, 7), (17, 3)]), st.floats(0, 2))
def test_bounds_never_exceed_distances(seed, shape, wide):
    cfg = IndexConfig(length=shape[0], segments=shape[1], cardinality=64)
    rng = np.random.default_rng(seed)
    x, q = rng.normal(size=(2, cfg.length))
    lower, upper = q - wide * rng.random(cfg.length), q + wide * rng.random(cfg.length)
    word = D.word_of(D.symbols_of(D.segment_means(x, cfg), 64), cfg)
    levels = [word[: i * cfg.digits] for i in range(cfg.bits + 1)]
    for lo, hi in ((q, q), (lower, upper)):
        bounds = D.box_bounds(levels, D.segment_means(lo, cfg), D.segment_means(hi, cfg), cfg)
        true = D.distances(x[None], lo, lo if lo is hi else hi)[0]
        assert (np.diff(bounds) >= -1e-12).all() and bounds[-1] <= true + 1e-9


def test_prefix_is_coarser_word():
    rng = np.random.default_rng(1)
    fine = IndexConfig(length=64, segments=8, cardinality=64)
    for means in rng.normal(size=(50, 8)):
        word = D.word_of(D.symbols_of(means, 64), fine)
        for bits in range(1, 6):
            coarse = IndexConfig(length=64, segments=8, cardinality=1 << bits)
            assert D.word_of(D.symbols_of(means, 1 << bits), coarse) == word[: 2 * bits]


def test_columns_and_kernels_agree(spark):
    cfg = IndexConfig(length=30, segments=7, cardinality=16)
    rng = np.random.default_rng(3)
    data = rng.normal(size=(40, 30))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "series_id long, values array<double>")
    for r in df.select("series_id", R.paa(F.col("values"), cfg).alias("p"), R.series_word(F.col("values"), cfg).alias("w")).collect():
        means = D.segment_means(data[r.series_id], cfg)
        assert np.allclose(r.p, means) and r.w == D.word_of(D.symbols_of(means, 16), cfg)


def test_constant_null_and_nan(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0],), ([1.0, None, 2.0],), ([1.0, float("nan"), 2.0],), (None,), ([1.0, 2.0, 3.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(R.valid(F.col("v"), 3)).collect()] == [True, False, False, False, True, False]
    got = [r[0] for r in df.select(R.z_normalise(F.col("v"))).collect()]
    assert got[0] is None and got[3] is None and np.allclose(got[4], [-1, 0, 1])


def test_config(tmp_path):
    assert IndexConfig().capacity == 111801
    odd = IndexConfig(length=30, segments=7)
    assert (odd.step, odd.word_length, odd.digits, odd.bits) == (5, 6, 2, 6)
    for bad in ({"segments": 0}, {"cardinality": 33}, {"sample_fraction": 0.0}):
        with pytest.raises(ValueError, match=r"need|breakpoints|must"):
            IndexConfig(**bad)
    with pytest.raises(ValueError, match="power-of-two"):
        IndexConfig(cardinality=10).require_indexable()
    assert WalkConfig(count=800_000).partitions() == 7 and WalkConfig(count=200_000_000).partitions() == 1615
    (tmp_path / "x.conf").write_text("length=64\n#segments=3\nsegments = 4\ncardinality=8 # no\nbloom=yes\n")
    values = read_properties(tmp_path / "x.conf")
    cfg = from_properties(IndexConfig, values)
    assert (cfg.length, cfg.segments, cfg.cardinality, cfg.bloom) == (64, 4, 64, True)
    assert truth("YES") and not truth("1")
    assert "capacity" in describe(cfg) and cfg.index_path("/x").endswith("-index") and "bloom" in cfg.bloom_path("/x")
    assert from_properties(QueryConfig, {"k": "7", "radius": "2.5"}).radius == 2.5
    assert LabelConfig().path("/x", "knn").startswith("/x-label-knn")
