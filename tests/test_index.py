from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.config import IndexConfig, LabelConfig, WalkConfig
from seriesloom.functions import distance as D
from seriesloom.operators import envelope, evaluate, filters, labels, search, stats
from seriesloom.plans import index as I
from seriesloom.plans import planner
from seriesloom.sources import storage, walks
from seriesloom.streaming import ingest

CFG = IndexConfig(length=64, segments=4, cardinality=64, max_records=40, leaf_threshold=10, sampling=False)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 64)).cumsum(1)
    return (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)


@pytest.fixture(scope="module")
def series(spark, data):
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], storage.SERIES).repartition(4, "series_id")
    return storage.materialise(rows, "series")


@pytest.fixture(scope="module")
def index(spark, series):
    return I.build(series, storage.scratch(spark, "index"), replace(CFG, bloom=True))


def ask(data, ids):
    return [search.Query(i, data[i], data[i]) for i in ids]


def brute(data, q, ids=None):
    ids = np.arange(len(data)) if ids is None else np.array(sorted(ids))
    d = D.distances(data[ids], q.lower, q.lower if q.scalar else q.upper)
    order = np.lexsort((ids, d))
    return [(int(ids[i]), d[i]) for i in order]


def test_each_record_has_one_partition(index, data):
    rows = index.series().select("series_id", "word", "pid").collect()
    assert sorted(r.series_id for r in rows) == list(range(len(data)))
    assert all(index.tree.pid(r.word) == r.pid for r in rows)
    sizes = {}
    for r in rows:
        sizes[r.pid] = sizes.get(r.pid, 0) + 1
    assert max(sizes.values()) <= CFG.capacity


def test_bins_never_mix_parents(index):
    for n in index.tree.nodes.values():
        if not n.leaf:
            own = [p for c in n.children if c.leaf for p in c.pids]
            others = [p for m in index.tree.nodes.values() if not m.leaf and m is not n for c in m.children if c.leaf for p in c.pids]
            assert not set(own) & set(others)


def test_partition_filter_reaches_the_scan(index):
    plan = index.series([0, 2])._jdf.queryExecution().executedPlan().toString()
    assert "pid" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.pid for r in index.series([0, 2]).select("pid").distinct().collect()} == {0, 2}


def test_sampling_of_derived_tables(spark, data):
    """Files are sampled of a plain table; of a derived one, whose files hold other rows, records."""
    where = storage.scratch(spark, "files")
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>").repartition(8).write.parquet(where)
    derived = storage.from_embeddings(spark.read.parquet(where)).where("series_id < 300")
    cfg = replace(CFG, sampling=True, sample_fraction=0.25)
    rows, share = I.sample(derived, cfg)
    assert share == 0.25 and rows.columns == ["series_id", "values"] and 30 < rows.count() < 130
    built = I.build(derived, storage.scratch(spark, "derived"), cfg)
    assert built.tree.partitions > 3 and built.series().count() == 300
    assert built.series().where(F.col("pid") == built.tree.overflow).count() < 150
    plain = storage.read_series(spark, storage.materialise(derived.repartition(8), "series")._path)
    rows, share = I.sample(plain, cfg)
    assert share == 0.25 and 0 < rows.count() < 300 and len(rows.inputFiles()) == 2


def test_queries_in_blocks(spark, series, index, data):
    asked = series.where("series_id % 10 = 0").selectExpr("series_id as qid", "values")
    answer = lambda qs: search.brute_knn(series, qs, 3)
    key = lambda df: sorted(tuple(r) for r in df.select("qid", "rank", "series_id").collect())
    assert key(search.each_block(asked, 64, answer, size=7)) == key(search.each_block(asked, 64, answer)) and len(key(search.each_block(asked, 64, answer))) == 150


def test_odd_records_are_passed_over(spark, data):
    rows = spark.createDataFrame([(1, [float("nan")] * 64), (2, [1.0] * 63), (3, None), (4, data[4].tolist()), (5, [*data[5].tolist()[:-1], None])], storage.SERIES)
    assert [r.series_id for r in search.brute_knn(rows, ask(data, [4]), 3).collect()] == [4]
    assert search.brute_range(rows.where("series_id < 4"), ask(data, [4]), 100.0).count() == 0


def test_exact_match_without_broadcast(spark, index, data, monkeypatch):
    monkeypatch.setattr(search, "MAX_PROBES", 0)
    rows = spark.createDataFrame([(i, data[i].tolist()) for i in range(5)] + [(9, (data[9] + 1e-6).tolist())], "qid long, values array<double>")
    assert {r.qid for r in search.exact_match(index, rows).where("found").collect()} == set(range(5))


def test_tree_is_written_and_read(index):
    again = planner.GlobalIndex.parse(index.tree.render(), CFG)
    assert again.render() == index.tree.render() and again.partitions == index.tree.partitions


def test_knn_kinds(index, data):
    queries = ask(data, range(0, 500, 25))
    placed = {r.series_id: r.pid for r in index.series().select("series_id", "pid").collect()}
    truth = {q.qid: brute(data, q)[:5] for q in queries}
    recalls = []
    for kind in (0, 1, 2):
        got = {}
        for r in search.knn(index, queries, 5, kind).collect():
            got.setdefault(r.qid, []).append((r.rank, r.series_id, r.dist))
        if kind:
            for q in queries:
                home = placed[q.qid]
                w = D.word_of(D.symbols_of(D.segment_means(q.lower, CFG), 64), CFG)
                pids = {home} if kind == 1 else {home, *search.plan_knn(index, [q], 5, 2)[q.qid]}
                assert home in pids and index.tree.pid(w) == home
                want = brute(data, q, [i for i, p in placed.items() if p in pids])[:5]
                assert [s for _, s, _ in sorted(got[q.qid])] == [s for s, _ in want]
        recalls.append(np.mean([len({s for _, s, _ in got[q.qid]} & {s for s, _ in truth[q.qid]}) for q in queries]))
    assert recalls[0] <= recalls[1] <= recalls[2]


def test_range_equals_brute_force(index, data):
    queries = ask(data, range(0, 500, 50))
    for radius in (0.0, 4.0, 7.0):
        got = sorted((r.qid, r.series_id) for r in search.range_search(index, queries, radius).collect())
        assert got == sorted((q.qid, i) for q in queries for i, d in brute(data, q) if d <= radius)
    assert search.range_search(index, queries, -1.0).count() == 0
    visits = search.range_report(index, queries, 4.0).collect()
    assert len(visits) == len(queries) and all(v.blocks >= 1 and v.internal_nodes + v.terminal_nodes >= 1 for v in visits)


def test_words_that_a_sample_missed_are_found(spark, series, data):
    few = I.build(series.where("series_id < 30"), storage.scratch(spark, "few"), CFG)
    few.tree.nodes = {p: n for p, n in few.tree.nodes.items() if not n.leaf or n.count > 2}
    far = planner.assign(I.tag(series, CFG).select("series_id", "values", "word"), few.tree)
    assert far.where(F.col("pid") == few.tree.overflow).count() > 0
    assert all(few.tree.overflow in own for own in search.plan_range(few, ask(data, [1]), 0.5).values())


def test_exact_match(spark, index, data, series):
    probes = [(i, data[i].tolist()) for i in range(0, 100, 7)] + [(1000 + i, (data[i] + 1e-6).tolist()) for i in range(0, 100, 7)]
    rows = spark.createDataFrame(probes, "qid long, values array<double>")
    plain = {r.qid: r for r in search.exact_match(index, rows).collect()}
    bloom = {r.qid: r for r in search.exact_match(index, rows, bloom=True).collect()}
    assert all(plain[q].found == bloom[q].found == (q < 1000) for q in plain)
    assert all(r.blocks == 1 for r in plain.values())
    with pytest.raises(ValueError, match="no series of length"):
        search.exact_match(index, spark.createDataFrame([(1, [1.0, 2.0])], "qid long, values array<double>"))


def test_intervals(spark, index, data):
    queries = [search.Query(i, data[i] - 0.2, data[i] + 0.3) for i in (0, 100, 250)]
    got = sorted((r.qid, r.series_id) for r in search.range_search(index, queries, 5.0).collect())
    assert got == sorted((q.qid, i) for q in queries for i, d in brute(data, q) if d <= 5.0)
    same = [search.Query(7, data[7], data[7].copy())]
    point = search.knn(index, ask(data, [7]), 5, 1).collect()
    assert [(r.series_id, round(r.dist, 9)) for r in search.knn(index, same, 5, 1).collect()] == [(r.series_id, round(r.dist, 9)) for r in point]
    for q in queries:
        words = {D.word_of(c, CFG) for c in envelope.itertools.product(*envelope.symbol_ranges(q.lower, q.upper, CFG))}
        assert D.word_of(D.symbols_of(D.segment_means(data[q.qid], CFG), 64), CFG) in words
        assert D.distances(data[q.qid][None], q.lower, q.upper)[0] == 0
        for order in range(7):
            picked = envelope.words_of(q.lower, q.upper, CFG, 6, order)
            assert len(picked) == len(set(picked)) <= 6 and set(picked) <= words


def test_word_orders(data):
    lower, upper = data[3] - 0.3, data[3] + 0.35
    ranges = envelope.symbol_ranges(lower, upper, CFG)
    every = list(envelope.itertools.product(*ranges))
    assert any(len(r) % 2 == 0 for r in ranges)
    lists = [sorted(r, key=lambda s, r=r: abs(s - sum(r) / len(r))) for r in ranges]  # stable: the lower of two comes first
    outwards = list(envelope.itertools.product(*lists))
    near = sorted(outwards, key=lambda c: sum(abs(a - b) for a, b in zip(c, outwards[0], strict=True)))
    middle = D.symbols_of(D.segment_means((lower + upper) / 2, CFG), 64).tolist()
    by_line = sorted(every, key=lambda c: sum(abs(a - b) for a, b in zip(c, middle, strict=True)))
    for m in (1, 6, 20, len(every)):
        assert envelope.combinations(lower, upper, CFG, m, 1) == near[:m]
        assert envelope.combinations(lower, upper, CFG, m, 2) == near[::-1][:m]
        assert envelope.combinations(lower, upper, CFG, m, 3) == by_line[:m]
        assert envelope.combinations(lower, upper, CFG, m, 4) == by_line[::-1][:m]
    assert envelope.combinations(lower, upper, CFG, 1, 6) == [tuple((r[0] + r[-1]) // 2 for r in ranges)]
    assert envelope.combinations(lower, upper, CFG, len(every), 0) == every
    steps = lambda c: sum(a - r[0] for a, r in zip(c, ranges, strict=True))
    for m in (2, 7, 60, 100, len(every) - 1):
        for order in (0, 5):
            got = envelope.combinations(lower, upper, CFG, m, order)
            assert len(set(got)) == len(got) == m and set(got) <= set(every)
            assert got == envelope.combinations(lower, upper, CFG, m, order)
        most = sum(len(r) - 1 for r in ranges)
        assert {round(i * most / (m - 1)) for i in range(m)} <= {steps(c) for c in got}


def test_diagonal_of_words():
    assert envelope._diagonal([range(0, 6)], 6) == [(i,) for i in range(6)]
    assert envelope._diagonal([range(0, 6)], 4) == [(0,), (2,), (3,), (5,)]  # 1.67, 3.33
    assert envelope._diagonal([range(0, 4), range(7, 8)], 3) == [(0, 7), (2, 7), (3, 7)]  # 1.5 goes up
    assert envelope._diagonal([range(2, 6)], 1) == [(3,)]


def test_one_word_and_heavy_word(spark):
    same = spark.createDataFrame([(i, [float(j % 2) + i * 1e-9 for j in range(64)]) for i in range(120)], storage.SERIES)
    built = I.build(same, storage.scratch(spark, "same"), CFG)
    assert built.series().count() == 120 and built.tree.partitions == 1
    nodes = built.nodes().collect()
    assert [(n.level, n.cnt, n.is_leaf) for n in nodes] == [(0, 120, True)]
    query = [search.Query(0, np.array([float(j % 2) for j in range(64)]), np.array([float(j % 2) for j in range(64)]))]
    assert search.knn(built, query, 500, 0).count() == 120
    assert search.knn(built, query, 500, 0, full=True).count() == 0


def test_bad_series_are_set_aside(spark):
    rows = spark.createDataFrame([(1, [float("nan")] * 64), (2, [1.0] * 63), (3, None), (4, [float(i) for i in range(64)])], storage.SERIES)
    assert [r.series_id for r in I.tag(rows, CFG).collect()] == [4]
    assert sorted(r.series_id for r in I.rejected(rows, CFG).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="not of length"):
        search.queries_of(spark.createDataFrame([(1, [1.0])], "qid long, values array<double>"), 64)


def test_ties_go_to_the_smaller_id(spark):
    x = [float(i) for i in range(64)]
    rows = spark.createDataFrame([(i, x) for i in (9, 3, 5)], storage.SERIES)
    q = [search.Query(0, np.array(x), np.array(x))]
    assert [r.series_id for r in search.brute_knn(rows, q, 2).orderBy("rank").collect()] == [3, 5]


def test_build_is_kept_and_planned_at_the_edge(spark, index, series):
    again = I.build(series, index.path, CFG)
    assert again.tree.partitions == index.tree.partitions
    tree = planner.plan([("0", 40), ("1", 41), ("10", 20), ("11", 21), ("2", 5)], replace(CFG, segments=4))
    assert {n.prefix: n.leaf for n in tree.nodes.values()} == {"": False, "0": True, "1": False, "10": True, "11": True, "2": True}
    assert tree.pid("000000") == tree.nodes["0"].pids[0] and tree.pid("f00000") == tree.overflow
    assert tree.by_count("100000", 30) == tree.nodes["1"].pids and "leaf" in tree.render()


def test_labels_and_reports(spark, series, index, data):
    cfg = LabelConfig(count=20, k=5, radius=6.0)
    exact = labels.exact_labels(series, cfg, 64).collect()
    assert sum(r.expected for r in exact) == 10 and len(exact) == 20
    queries = ask(data, range(0, 500, 25))
    known = labels.knn_labels(series, queries, cfg)
    for r in known.collect():
        assert [n.series_id for n in r.neighbours] == [i for i, _ in brute(data, search.Query(r.qid, data[r.qid], data[r.qid]))[:5]]
    truth = labels.flat(known)
    assert evaluate.knn_report(truth, truth, 1.0).first().recall == 1.0
    empty = truth.where("false")
    assert evaluate.knn_report(empty, empty).first().queries == 0
    ranges = labels.range_labels(series, queries, LabelConfig(radius=6.0))
    assert labels.within(ranges, 0.0).count() == 0
    report = evaluate.range_report(labels.flat(ranges), search.range_search(index, queries, 6.0), search.range_report(index, queries, 6.0)).first()
    assert report.min_recall == 1.0


def test_filters(index):
    assert filters.bloom_size(1000, 0.1) == (4793, 3)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**62, (2, 500))
    bits = filters.bloom_bits(a, b, 4000, 3)
    assert all(filters.bloom_contains(bits, 4000, 3, int(x), int(y)) for x, y in zip(a, b))
    wrong = sum(filters.bloom_contains(bits, 4000, 3, int(x) + 1, int(y) + 1) for x, y in zip(a, b))
    assert wrong < 100 and 0 < filters.expected_rate(bits, 4000, 3) < 0.1
    assert filters.combine(bits, bytes(500)) == bits and filters.combine(bits, bytes(500), union=False) == bytes(500)
    with pytest.raises(ValueError, match="different sizes"):
        filters.combine(bits, b"")
    assert index.bloom().select("pid").distinct().count() == index.series().select("pid").distinct().count()
    words = index.series().select("pid", "word").distinct()
    other = words.select(((F.col("pid") + 1) % 5).cast("int").alias("pid"), F.concat(F.lit("zz"), "word").alias("key"))
    wrong = filters.might_contain(other, index.bloom()).agg(F.avg(F.col("maybe").cast("int"))).first()[0]
    assert 0 < wrong < 2 * CFG.bloom_rate  # the false positive rate that was asked for, about
    assert filters.might_contain(words.withColumnRenamed("word", "key"), index.bloom()).where("not maybe").count() == 0
    one = filters.read_filter(index.spark, f"{index.path}/bloom", 2)
    assert {r.pid for r in one.collect()} == {2} and filters.might_contain(words.where("pid = 2").withColumnRenamed("word", "key"), one).where("not maybe").count() == 0
    assert "pid" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    same = filters.bloom_table(index.series().select("pid", "word"), CFG, m=100_000).cache()
    ones = lambda df: sum(bin(x).count("1") for r in df.collect() for x in bytes(r.bitmap))
    both, two = same.where("pid < 2"), [{(r.bucket, i, b) for r in same.where(f"pid = {p}").collect() for i, x in enumerate(bytes(r.bitmap)) for b in range(8) if x >> b & 1} for p in (0, 1)]
    assert ones(filters.united(both)) == len(two[0] | two[1]) and ones(filters.intersected(both)) == len(two[0] & two[1])
    with pytest.raises(ValueError, match="different sizes"):
        filters.united(index.bloom())
    wide = filters.wide_positions(a.astype(np.uint64), b.astype(np.uint64), 4000, 3)
    assert wide.shape == (500, 3) and wide.max() < 4000 and len(np.unique(wide[:, 1])) > 400
    c = filters.CuckooFilter(300)
    for x in a[:300]:
        c.add(int(x))
    assert all(int(x) in c for x in a[:300]) and c.size == 300
    assert c.remove(int(a[0])) and int(a[1]) in filters.CuckooFilter.from_bytes(c.to_bytes())
    with pytest.raises(OverflowError):
        for x in a:
            c.add(int(x))
            c.add(int(x) ^ 7)


def test_walks_do_not_depend_on_partitions(spark):
    cfg = WalkConfig(count=40, length=64, bands=True, band_share=0.25, band_segments=2)
    one = sorted(map(str, walks.random_walks(spark, cfg).collect()))
    assert one == sorted(map(str, walks.random_walks(spark, replace(cfg, block_mb=0.002)).collect()))
    bands = walks.with_bands(walks.random_walks(spark, cfg), cfg).collect()
    for r in bands:
        assert sum(a < b for a, b in zip(r.lower, r.upper)) == 16 and all(a <= b for a, b in zip(r.lower, r.upper))
    with pytest.raises(ValueError, match="do not fit"):
        walks.with_bands(walks.random_walks(spark, cfg), replace(cfg, band_share=0.9, band_segments=1))


def test_storage(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    storage.write_bytes(spark, f"{path}/a.bin", b"abc")
    storage.write_bytes(spark, f"{path}/_SUCCESS", b"")
    assert storage.read_bytes(spark, f"{path}/a.bin") == b"abc"
    assert [n for _, n in storage.listing(spark, path)] == [3]
    assert storage.exists(spark, path) and storage.delete(spark, path) and not storage.exists(spark, path)
    with pytest.raises(FileNotFoundError):
        storage.require(spark, index=path)
    with pytest.raises(FileNotFoundError):
        I.open_index(spark, path)
    assert storage.partition_path("/r", 7) == "/r/series/pid=7"


def test_stream(spark, series, data):
    built = I.build(series.where("series_id < 250"), storage.scratch(spark, "part"), replace(CFG, bloom=True))
    arriving = storage.scratch(spark, "arriving")
    series.where("series_id >= 250").write.parquet(arriving)
    ingest.ingest(spark.readStream.schema(series.schema).parquet(arriving), built, storage.scratch(spark, "progress"), once=True).awaitTermination()
    grown = ingest.refresh(built)
    assert grown.series().count() == 500 and grown.tree.nodes[""].count == 500
    assert sum(n.count for n in grown.tree.leaves()) + grown.series().where(F.col("pid") == grown.tree.overflow).count() == 500
    assert grown.nodes().where("level = 0").agg(F.sum("cnt")).first()[0] == 500
    queries = ask(data, [300, 400])
    got = sorted((r.qid, r.series_id) for r in search.range_search(grown, queries, 6.0).collect())
    assert got == sorted((q.qid, i) for q in queries for i, d in brute(data, q) if d <= 6.0)


def test_least_thresholds(spark):
    rows = spark.createDataFrame([(1, "a", 0, 3.0), (1, "b", 0, 2.0), (1, "c", 4, 5.0), (2, "a", 0, 1.0)], "qid long, word string, pid int, threshold double")
    assert sorted(tuple(r) for r in evaluate.least_thresholds(rows).collect()) == [(1, 0, 2.0), (1, 4, 5.0), (2, 0, 1.0)]


def test_leaves_and_statistics(spark, index):
    held = I.with_leaf(index)
    assert held.count() == 500 and held.where(~F.startswith("word", F.col("leaf"))).count() == 0
    assert stats.file_sizes(spark, f"{index.path}/series").count() > 1
    assert stats.distinct_words(I.tag(index.series(), CFG), CFG, approximate=True).count() == 6
    assert stats.summary(index.series().where("false"), "pid").first().n == 0
    assert stats.equal_histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x").collect()[0].n == 2
