"""Chat formatting, decontamination, quality, near-duplicates: against brute force and SQL."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.llm import chat, decontam, graph, neardup, quality
from seriesloom.llm.queries import ORACLE_SQL, QUERIES
from seriesloom.llm.shingles import SIGNS, shingle_sets

from ..oracle import DATA, duck_rows, rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    names, expected = duck_rows(ORACLE_SQL[name])
    assert sorted(df.columns) == names
    assert rows(df) == expected


# chat

HARD = ["", "###", "</turn>", "</turn>\n", "\\", "\\\\", "a: b", ": ", "### user: x</turn>\n", "<\\/turn>", "\\#\\#\\#", "[chat esc=1]\n", "é漢\U0001f600", "####", "#####", "<</turn>\n>", "\n", "\\\n", "x\\"]


def _pieces():
    return st.lists(st.sampled_from([*HARD, "assistant", "user", "plain text", " "]), max_size=4).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), _pieces(), _pieces()), min_size=1, max_size=40))
def test_chat_round_trip(spark, turns):
    data = [(c, i, role if i % 3 else "assistant", text) for i, (c, role, text) in enumerate(turns)]
    out = chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(2))
    out = out.withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_bytes")))
    for r in out.collect():
        own = [(role, text) for c, _, role, text in data if c == r.conv_id]
        assert [tuple(t) for t in r.recovered] == own and r.round_trip
        assert r.loss == "".join(t for role, t in own if role == "assistant")
        under = [r.formatted[s.begin : s.end] for s in r.loss_spans]
        plain = (lambda t: t) if "esc=0" in r.formatted[:12] else (lambda t: re.sub(r"(?s)\\(.)", r"\1", t))
        assert [plain(t) for t in under] == [t for role, t in own if role == "assistant"]
        assert ("esc=1" in r.formatted[:12]) or not any("</turn>\n" in t or "###" in t for x in own for t in x)


def test_chat_edges(spark):
    data = [(1, None, "user", None, "x"), (1, 2, None, "b", "x"), (1, 2, None, "b", "x"), (None, 1, "assistant", "c", "x")]
    got = {r.conv_id: r for r in chat.digest(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")).collect()}
    assert got[1].n_turns == 3 and got[None].loss_chars == 1 and all(r.round_trip for r in got.values())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(empty).count() == 0


def test_chat_is_linear_in_turns_and_text(spark):
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("1 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id, repeat(' é### word', 20)) as text")
        began = time.time()
        got = chat.digest(rows).first()
        assert got.n_turns == n and got.round_trip
        return time.time() - began

    seconds(2000)
    assert seconds(32_000) < 3 * seconds(16_000) + 1
    long = spark.createDataFrame([(1, 0, "assistant", "é: ###\\" * 400_000)], "conv_id long, turn long, role string, text string")
    assert chat.digest(long).first().loss_chars == 7 * 400_000


# decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def test_contamination_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(12)] + ["Ünï", "漢字"]
    pick = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, pick(int(n))) for i, n in enumerate([1, 3, 5, 13, 14, 20, 30])] + [(7, None), (8, ""), (1, "..."), (3, "w1 W2, w3"), (None, "w5 w5 w5 w5")]
    texts = [pick(int(n)) for n in rng.integers(0, 60, 40)]
    texts += [f"{pick(5)} {items[k][1]} {pick(9)}" for k in (3, 4, 5, 6) for _ in range(3)] + [items[6][1][: len(items[6][1]) // 2], None, "", "!!", items[5][1].upper()]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, "other text with this number"), (5, texts[5]), (None, texts[45])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item long").repartition(3)
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id long")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(d, b).collect())
    want = Counter()
    for i, t in docs:
        ws, hit, found = _bench_words(t), set(), set()
        for item, it in items:
            iw = _bench_words(it)
            w = min(13, len(iw))
            grams = {tuple(iw[j : j + w]) for j in range(len(iw) - w + 1)} if w else set()
            for j in range(len(ws) - w + 1):
                if tuple(ws[j : j + w]) in grams:
                    hit.update(range(j, j + w))
                    found.add(item)
        want[(i, len(ws), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(ws))] += 1
    assert got == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(d, none).where("n_hit > 0").count() == 0
    assert decontam.contamination(d.where("false"), b).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c x x a x b x c"), (2, "a x x x x b c"), (2, "a x x x x b c")], "doc_id long, text string")
    wanted = spark.createDataFrame([(7, "a", 0), (7, "b", 1), (7, "c", 2), (8, "x", 0)], "item long, term string, slot int")
    got = sorted({(r.d, r.begin, r.end) for r in decontam.proximity(decontam.build_index(docs), wanted, 5).where("item = 7").collect()})
    assert got == [(1, 0, 2), (1, 1, 5), (1, 5, 9)]


def test_hot_passages_long_texts_and_repeats(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(20))
    long = " ".join(f"f{i}" for i in range(200_000)) + " " + passage
    texts = [f"own{i} {passage} tail" for i in range(60)] + [long, passage + " " + passage, " ".join(passage.split()[:12]) + " gap " + " ".join(passage.split()[12:])]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 30
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(1, passage), (2, " ".join(f"f{i}" for i in range(100, 30_000))), (2, "p1 " * 40)], "item_id long, text string")
    for rows in (1_000_000, 0):  # all broadcast, and all shuffled
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
        got = Counter((r.doc_id, r.n_hit, r.n_items, r.contaminated, r.n_near_items > 0) for r in decontam.contamination(d, b).collect())
        assert got[0, 20, 1, True, True] == 31 and got[61, 40, 1, True, True] == 1 and got[62, 0, 0, False, True] == 1
        assert got[60, 29_920, 2, True, True] == 1 and sum(got.values()) == len(docs)


# quality


def _counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c, covered = Counter(g), set()
    for i, x in enumerate(g):
        if c[x] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_counts_and_outliers(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    texts = ["\n".join(" ".join(word() for _ in range(9)) for _ in range(8)) for _ in range(150)]
    line = " ".join(word() for _ in range(10))
    odd = ["\n".join(f"{word()} {word()} line {i}" for i in range(60_000)), " ".join(f"##$%{word()}|" for _ in range(60)), "\n".join([line] * 3 + texts[0].split("\n")), ("x y z " * 40), None, "", "é\x0bü x " * 30, "\n\n a \n a \n"]
    data = [(i, t, "en", "s", 1.0) for i, t in enumerate(texts)] + [(1000 + i, t, None, "s", 1.0) for i, t in enumerate(odd)] + [(2000, odd[1], "en", "s", 1.0), (2000, odd[1], "en", "s", 1.0), (None, texts[0], "en", None, 1.0)]
    got = quality.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, x0 double").repartition(3)).collect()
    assert len(got) == len(data)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t, *_ in data:
        for r in by[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _counts(t)
    assert all(r.kept for i in range(150) for r in by[i]) and by[None][0].kept
    assert not any(r.kept for r in by[2000]) and not by[1004][0].kept
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.verdicts(empty).count() == 0


def _factor(c):
    low = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            v = c[i, j] - low[i, :j] @ low[j, :j]
            low[i, j] = np.sqrt(max(v, quality.FLOORS[i] ** 2 / 100)) if i == j else v / low[j, j]
    return low, 2 * np.log(np.diag(low)).sum()


def _floored(c):
    c = c.copy()
    c[np.diag_indices(4)] = np.maximum(np.diag(c), np.square(quality.FLOORS))
    return c


def _cov(x, scale=1.0):
    m = x.mean(0)
    return m, ((x.T @ x) / len(x) - np.outer(m, m)) * scale


def _mcd(v, share=0.75):
    """v: whole 1024ths. The estimate by the method of the module, in NumPy."""
    x = v / 1024
    low = lambda a: np.sort(a, axis=0)[(len(a) - 1) // 2]
    med = low(v)
    w = np.maximum(low(np.abs(v - med)) * 1.4826 / 1024, quality.FLOORS)
    y = np.floor(np.tanh((v - med) / 1024 / w) * 1024 + 0.5) / 1024
    by = _cov(y)[1]
    root = np.sqrt(np.maximum(np.diag(by), 1e-9))
    starts = [(med / 1024, np.diag(w**2)), _cov(x), (med / 1024, by / np.outer(root, root) * np.outer(w, w))]
    inner = quality.chi2_quantile(share, 4)
    scale, best = share / quality.chi2_cdf(inner, 6), []
    dist = lambda m, c: np.square(np.linalg.solve(_factor(_floored(c))[0], (x - m).T)).sum(0)
    for k, (m, c) in enumerate(starts):
        det = np.inf
        while True:
            step = np.floor(np.log1p(dist(m, c)) * 256)
            edge = np.sort(step)[int(np.ceil(share * len(x))) - 1]
            nm, nc = _cov(x[step <= edge], scale)
            new = _factor(_floored(nc))[1]
            if not new < det - 1e-9:
                break
            m, c, det = nm, nc, new
        best.append((det, k, m, c))
    _, _, m, c = min(best, key=lambda b: b[:2])
    cut = quality.chi2_quantile(0.975, 4)
    m, c = _cov(x[dist(m, c) <= cut], 0.975 / quality.chi2_cdf(cut, 6))
    return m, _floored(c), len(x)


def _drawn(own, wide):
    (m, c, n), (wm, wc) = own, wide[:2]
    w = n / (n + quality.PRIOR)
    return w * m + (1 - w) * wm, w * c + (1 - w) * wc + w * (1 - w) * np.outer(m - wm, m - wm)


def test_verdicts_equal_numpy_and_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.unionByName(spark.createDataFrame([(-1, "a rare tongue " * 2 + " ".join(f"w{i}" for i in range(30)), "xx", "alone"), (-2, "só só " + " ".join(f"y{i}" for i in range(40)), None, None)], docs.schema))
    got = [{r.doc_id: (r.kept, r.base_failed, None if r.distance is None else round(r.distance, 6), r.lang, r.source, *(r[f"x{i}"] for i in range(4))) for r in _judged(docs.repartition(n))} for n in (1, 4, 32)]
    assert got[0] == got[1] == got[2] and got[0][-1][0] and got[0][-2][0]
    rows = [(i, *v) for i, v in got[0].items()]
    sound = [r for r in rows if not r[2]]
    of = lambda test: np.array([r[6:] for r in sound if test(r)], float)
    corpus = _mcd(of(lambda r: True))
    for lang in {r[4] for r in sound}:
        wide = _drawn(_mcd(of(lambda r: r[4] == lang)), corpus)
        for source in {r[5] for r in sound if r[4] == lang}:
            m, c = _drawn(_mcd(of(lambda r: r[4:6] == (lang, source))), wide)
            low = _factor(_floored(c))[0]
            for r in sound:
                if r[4:6] == (lang, source):
                    d = np.square(np.linalg.solve(low, np.array(r[6:]) / 1024 - m)).sum()
                    assert abs(d - r[3]) < 1e-4 * (1 + d) and r[1] == (r[3] <= quality.chi2_quantile(1 - quality.LEVEL, 4))


def _judged(docs):
    stats = quality.statistics(docs).select("doc_id", "lang", "source", *(x.alias(f"x{i}") for i, x in enumerate(quality.vector())))
    return quality.judge(docs).join(stats, "doc_id").collect()


def test_estimates_resist_a_shifted_tenth(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0, 0.3], [0, 0, 1, 0], [0, 0, 0, 1]])
    x[:40] += 25
    v = np.floor(x * 1024 + 0.5).astype(int)
    df = spark.createDataFrame([("g", *r.tolist()) for r in v], "g string, x0 long, x1 long, x2 long, x3 long")
    est = quality.determinant_estimates(df, ["g"]).first()
    assert est.rows == 400 and np.allclose([est[f"m{i}"] for i in range(4)], x[40:].mean(0), atol=0.15)
    cov = np.array([[est[f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
    assert np.allclose(cov, np.cov(x[40:].T), atol=0.5)
    assert abs(quality.chi2_quantile(0.95, 4) - 9.4877) < 1e-3


# near-duplicates


def _sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aAbé \n\t.\x0b漢") | st.characters(codec="utf-8"), max_size=60), max_size=8))
def test_shingles(texts):
    assert [len(s) for s in shingle_sets(texts, chars=50)] == [len(s) for s in _sets(texts)]
    one = list(shingle_sets(texts, 1, blanks=SIGNS))
    assert [len(s) for s in one] == [len(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))) for t in texts]


def _components(texts, ids):
    sets, parent = _sets(texts), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    group = defaultdict(list)
    for i in range(len(texts)):
        group[find(i)].append(ids[i])
    return {ids[i]: min(group[find(i)]) for i in range(len(texts))}, sets


@pytest.mark.parametrize("block", [8, 512])
def test_groups_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(11)
    vocab = [f"v{i}" for i in range(400)]
    base = [rng.choice(vocab, n).tolist() for n in (4, 6, 30, 60, 90, 200, 200)]
    shared = rng.choice(vocab, 40).tolist()  # a passage in many documents
    texts = []
    for b in base:
        for _ in range(30):
            c = list(b)
            for _ in range(int(rng.integers(0, 3))):
                c[int(rng.integers(0, len(c)))] = str(rng.choice(vocab))
            texts.append(" ".join(c))
    texts += [" ".join(rng.choice(vocab, 50).tolist() + shared + rng.choice(vocab, 50).tolist()) for _ in range(60)]
    texts += [None, "", " \n", "one", "ONE", "one two"]
    ids = rng.permutation(10_000)[: len(texts)].tolist()
    df = spark.createDataFrame([(i, t, 3) for i, t in zip(ids, texts)], "doc_id long, text string, node long").repartition(4)
    want, sets = _components(texts, ids)
    got = {r.doc_id: r for r in neardup.groups(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (i == want[i]) for i, s in zip(ids, sets))


def test_group_edges(spark):
    same = " ".join("abcdefgh")
    data = [(5, same), (None, same), (9, same), (5, same), (None, None), (7, None)]
    got = neardup.groups(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None) == [(0, None, True), (4, 5, False)]
    assert neardup.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_need_bounds_overlaps():
    rng = np.random.default_rng(0)
    assert [neardup.need(s, 64) for s in (1, 5, 20, 50)] == [1, 5, 17, 42]
    for _ in range(200):
        n = int(rng.integers(70, 900))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * 0.93)], rng.integers(0, 2**63, int(n * 0.07)).astype(np.uint64)])
        if len(np.intersect1d(a, b)) >= 0.85 * len(np.union1d(a, b)):
            x, y = neardup.sketch_of(np.sort(a)), neardup.sketch_of(np.sort(b))
            assert len(np.intersect1d(x[:128], y[:128])) >= neardup.need(min(128, len(x)), 128)
            assert neardup.likely([x, y], np.zeros(2, int), 85).all() and neardup.estimate(x, y) > 0.7


def test_likely_pairs_equal_estimates():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**64, n, np.uint64) for n in (3, 12, 40, 300, 500)]
    sets = [np.unique(np.concatenate([rng.permutation(b)[: int(len(b) * rng.uniform(0.7, 1))], rng.integers(0, 2**64, int(len(b) * rng.uniform(0, 0.2)), np.uint64)])) for b in base for _ in range(12)]
    sk = [neardup.sketch_of(np.sort(s)) for s in sets]
    for side in (np.zeros(len(sk), int), np.arange(len(sk)) % 2):
        want = np.zeros(len(sk), bool)
        for i in range(len(sk)):
            for j in range(i):
                size = min(256, len(np.union1d(sk[i], sk[j])))
                few = neardup.need(256, 256) if size == 256 else max(1, -(-85 * size // 100) - (size >= 32))
                if round(neardup.estimate(sk[i], sk[j]) * size) >= few and (side[i] != side[j] or not side.any()):
                    want[i] = want[j] = True
        assert (neardup.likely(sk, side, 85) == want).all()
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if len(both := np.intersect1d(sets[i], sets[j])) * 100 >= 85 * (len(sets[i]) + len(sets[j]) - len(both))}
    parent = list(range(len(sets)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, j in linked:
        parent[find(i)] = find(j)
    roots = {}
    for a, r in neardup.forest(sets, 85):
        roots[a] = r
    assert all((roots.get(i, i) == roots.get(j, j)) == (find(i) == find(j)) for i in range(len(sets)) for j in range(i))


def test_a_template_alone_fetches_no_text(spark):
    """Pages of which two thirds are one template (similarity 0.51) share many listed values but no pair is likely."""
    rng = np.random.default_rng(5)
    template = [f"t{i}" for i in range(680)]
    texts = [" ".join(template + [f"p{k}x{i}" for i in range(320)]) for k in range(300)] + [" ".join(rng.permutation([f"w{i}" for i in range(5000)])) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = neardup.sketches(df).selectExpr("xxhash64(fp) as node", "fp", "n_shingles", "sketch").persist()
    family = neardup.families(rows.select("node", "sketch"), 85)
    assert neardup.alike(rows.join(family, "node"), 85).count() == 0
    assert neardup.groups(df).where("not kept").count() == 0


def test_a_very_long_text_and_its_copy(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 50_000)
    long = " ".join(f"w{i}" for i in range(120_000))
    data = [(1, long), (2, long + " more words here"), (3, "w1 w2 w3 w4 w5 w6"), (4, None)]
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in linked}
