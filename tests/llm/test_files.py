"""Token table, packing, archives: exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import packing, token_table, warc
from seriesloom.llm.queries import vocabulary
from seriesloom.llm.shared import fresh
from seriesloom.llm.tokens import encoder, slices

from ..oracle import DATA

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
TEXTS = ["", None, "a", "Hello, world's end\n\n  x", "word " * 9000, "<|endoftext|> é ß 漢字 \x85  z", "same", "same", " " * 50, "x\ny\r\nz\t1234567"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "other") for i, t in enumerate(TEXTS)] + [(None, "no id", "o"), (3, "again three", "o"), (6, "same", "o"), (-5, "minus", "o")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_no_shared_folder_on_many_machines():
    from seriesloom.llm.shared import shared_dir
    from seriesloom.sources.storage import scratch

    class Session:
        def __init__(self, **conf):
            self.conf = self
            self.held = {k.replace("_", "."): v for k, v in conf.items()}

        def get(self, key, default=None):
            return self.held.get(key, default)

        def set(self, key, value):
            self.held[key] = value

    for where in (shared_dir, lambda s: scratch(s, "x")):
        with pytest.raises(ValueError, match="that the driver and all executors share"):
            where(Session(spark_master="spark://host:7077"))
        assert where(Session(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs://n/x")).startswith("hdfs://n/x")
        assert where(Session(spark_master="local[4]")).startswith("file://")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé' .,\n\t 1λ漢ß \x1f́İΣς") | st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_cached_ids_equal_the_library(texts):
    for path in (BYTE, WORD):
        e = encoder(path)
        assert e.ids(texts) == e.encode(texts)
        column = pa.array([*texts, None], pa.string())
        got = [x.tobytes() for _, part in slices(column, 60) for x in e.column(part)]
        assert got == e.encode([*texts, ""])


def _ids(path, text, end=2):
    return np.frombuffer(encoder(path).encode([text or ""])[0], "<u4").tolist() + [end]


def test_token_table(spark, docs):
    root = fresh(spark, "table")
    token_table.write_table(docs, root, BYTE, 2, partitions=4)
    got = token_table.read_table(spark, root).collect()
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((i is not None, i or 0, np.array(_ids(BYTE, t), "<u4").tobytes()) for i, t in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i or 0))
    keys = spark.createDataFrame([(4,), (-5,), (None,), (77,), (6,)], "doc_id long")
    found = sorted((r.doc_id or 0, len(r.ids) // 4) for r in token_table.lookup(spark, root, keys).collect())
    assert found == sorted([(4, len(_ids(BYTE, TEXTS[4]))), (-5, len(_ids(BYTE, "minus"))), (0, len(_ids(BYTE, "no id"))), (6, len(_ids(BYTE, "same"))), (6, len(_ids(BYTE, "same")))])


def test_token_table_of_nothing(spark, docs):
    assert token_table.digest(docs.where("false"), BYTE, 2).count() == 0


def test_digests_equal_brute_force(spark, monkeypatch):
    """op6 and op4 over a whole table, with a very long text and a row that repeats, against the library text by text."""
    from seriesloom.llm import queries

    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    more = [(-3, "words and more, " * 60_000), *[(-1, "the same again")] * 300, (None, None), (None, "x")]
    docs = table.unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(5)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(token_table.digest(docs, BYTE, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    at, want = 0, {}
    for i, t in rows:
        raw = np.array(_ids(BYTE, t), "<u4").tobytes()
        want.setdefault(i, []).append((len(raw) // 4, zlib.crc32(raw)))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(want.values())
    pieces = packing.digest(docs, WORD).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array(_ids(WORD, t), "<u4"))
    sequences, used = {}, {}
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.padded_to))
        used[p.doc_id] = used.get(p.doc_id, 0) + p.length
    assert used == {i: sum(map(len, xs)) for i, xs in ids.items()}
    for places in sequences.values():
        ends = [0, *(o + n for o, n, _ in sorted(places))]
        assert [o for o, _, _ in sorted(places)] == ends[:-1] and ends[-1] == places[0][2] <= 4096
        assert places[0][2] == 4096 or places[0][2] & (places[0][2] - 1) == 0
    assert {"op4_packing", "op6_token_table"} <= set(queries.QUERIES)


def test_shard_of_many_keys(tmp_path):
    import pyarrow as pa

    rng = random.Random(1)
    entries = sorted({rng.randrange(-(10**9), 10**9) for _ in range(3000)})
    path = str(tmp_path / "x.sst")
    writer = token_table.ShardWriter(pa.OSFile(path, "wb"), block_bytes=1000)
    for k in entries:
        writer.add(token_table.key_of(k), np.array([abs(k) % 70000, 2], "<u4"))
    writer.close()
    reader = token_table.ShardReader(pa.memory_map(path))
    assert len(reader.index) > 20 and reader.entries == len(entries)
    for k in entries[::37]:
        assert [x.tolist() for x in reader.find(token_table.key_of(k))] == [[abs(k) % 70000, 2]]
    absent = [k for k in range(1000) if k not in set(entries)]
    assert not any(reader.find(token_table.key_of(k)) for k in absent)


def check_packing(docs_rows, pieces, window):
    tokens = {}
    for i, t in docs_rows:
        tokens.setdefault(i, []).append(np.array(_ids(WORD, t), "<u4"))
    sequences, used = {}, {}
    for p in pieces:
        assert any(len(x) == p.doc_tokens and x[p.start : p.start + p.length].tobytes() == p.ids for x in tokens[p.doc_id])
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.padded_to))
        used[p.doc_id] = used.get(p.doc_id, 0) + p.length
    assert used == {i: sum(map(len, xs)) for i, xs in tokens.items()}
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length, size in sorted(places):
            assert offset == at
            at += length
        assert at <= size <= window
        padding += size - at
    return padding


@pytest.mark.parametrize("window", [8, 64, 4096])
def test_packing(spark, docs, window):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packing(rows, packing.pack(docs, WORD, window=window).collect(), window) == 0
    assert packing.pack(docs.where("false"), WORD).count() == 0


def test_packing_of_many_lengths(spark):
    rng = random.Random(2)
    rows = [(i, "word " * int(rng.expovariate(1 / 30))) for i in range(2000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORD, window=128).collect()
    assert check_packing(rows, pieces, 128) == 0
    combined = [p for p in pieces if p.sequence_id >= 1 << 60]
    assert len(combined) > len(pieces) / 2  # most are placed by the solved counts


def test_solver_reaches_the_histogram():
    h = np.zeros(100, np.int64)
    h[[10, 20, 30, 40, 60, 70, 80, 90]] = 50
    combos = packing.combine(h, 100)
    assert (combos.sum(1) == 100).all()
    counts = packing.solve(h, combos)
    use = np.bincount(combos.ravel(), weights=np.repeat(counts, 4), minlength=100)
    use[0] = 0
    assert (use <= h).all() and use.sum() >= 0.8 * h.sum()
    assert len(packing.solve(h * 0, packing.combine(h * 0, 100))) == 0


PAGES = [(5, "http://www.b.example.org/x?b=2&a=1#f", "<p>one</p>"), (2, "https://a.example.com:8080/", "<p>one</p>"), (9, None, None), (7, "bad url\r\nX: y", ""), (None, "http://c.org", "<p>one</p>"), (3, "http://ü.de/ä", "\r\n\r\nWARC/1.1 é漢"), (2, "https://a.example.com:8080/", "<p>one</p>"), (11, "http://d.org/", "z" * 100000)]


def test_archives(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    root = fresh(spark, "warc")
    warc.build_index(warc.write_archives(pages, root, file_bytes=500), root, lines=2)
    got = warc.read_records(warc.lookup(pages, root), root).collect()
    assert len(got) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for r in got:
        html = next(h or "" for i, _, h in PAGES if i == r.page_id)
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        revisit = r.page_id != first[html]
        assert (r.record_type, r.refers_to) == (("revisit", first[html]) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == raw
    index = warc.CaptureIndex.open(spark, root)
    some = warc.lookup(spark.createDataFrame([("http://c.org",), ("http://nowhere.org/",), ("http://c.org",), (None,)], "url string"), root)
    assert sorted(str(r.page_id) for r in some.collect()) == ["9", "None"]
    assert [x[0] for x in index.fetch("http://b.example.org/x?a=1&b=2")] == [5]
    assert len(index.fetch("https://a.example.com:8080/")) == 2 and index.fetch("http://nowhere.org/") == []
    assert warc.digest(pages, min_bytes=50).where("record_type = 'revisit'").count() == 0
    assert warc.digest(pages.where("false")).count() == 0


def test_reading_back_measures_payloads(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.org/", "abc"), (2, "http://b.org/", "abc"), (3, "http://c.org/", "x" * 3_000_000)], "page_id long, url string, html string")
    assert [(r.payload_bytes, r.payload_digest) for r in warc.digest(pages).where("page_id = 3").collect()] == [(3_000_000, warc.digest_of(b"x" * 3_000_000))]
    good = warc.record_bytes(1, "http://a.org/", b"abcdef", hashlib.sha1(b"abcdef").digest(), None, False, "2024-01-01T00:00:00Z")
    cut_short = good.replace(b"\r\nabcdef\r\n", b"\r\nabc\r\n")
    for bad in (cut_short, good.replace(b"abcdef", b"abcdeg")):
        with pytest.raises(ValueError, match="not what its headers say"):
            warc.parse_record(bad)
    rows = [(1, 3, "D", "response", None), (2, 3, "D", "revisit", 1)]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    assert warc.resolved(spark.createDataFrame(rows, schema)).count() == 2
    for wrong in ((2, 4, "D", "revisit", 1), (2, 3, "E", "revisit", 1), (2, 3, "D", "revisit", 7)):
        with pytest.raises(Exception, match="a revisit disagrees"):
            warc.resolved(spark.createDataFrame([rows[0], wrong], schema)).collect()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)  # many digests: a hashed join
    assert sorted((r.page_id, r.refers_to) for r in warc.digest(pages).collect()) == [(1, None), (2, 1), (3, None)]


def test_a_hot_url_has_many_blocks(spark):
    pages = spark.range(500).selectExpr("id as page_id", "if(id % 3 = 0, 'http://hot.org/', concat('http://h', id, '.org/')) as url", "cast(id as string) as html").repartition(3)
    root = fresh(spark, "warc")
    files = warc.build_index(warc.write_archives(pages, root), root, lines=10)
    assert files.agg({"blocks": "sum"}).first()[0] >= 50
    assert len(warc.CaptureIndex.open(spark, root).places("http://hot.org/")) == 167
    assert warc.lookup(pages, root).distinct().count() == warc.lookup(pages, root).count() == 500


def test_archive_is_plain_gzip(spark):
    raw = warc.record_bytes(1, "http://x.org/", b"abc", hashlib.sha1(b"abc").digest(), None, False, "2024-01-01T00:00:00Z")
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and warc.parse_record(raw)[6] == b"abc"
    assert zlib.decompress(zlib.compress(raw)) == raw
    assert warc.capture_key("https://www.Example.org/A/?b=1&a=2") == "org,example)/a/?a=2&b=1"
