"""Packing of token sequences into windows of fixed length (operator 4).

Method. Each document's ids (with the end id) give full windows, which need no partner, and a remainder shorter than a
window. The remainders' length histogram, at most ``window - 1`` numbers however large the corpus, goes to the driver.
There, combinations of two to four lengths that fill a window exactly are enumerated, how often to use each is solved by
non-negative least squares against the histogram and rounded (as far as lengths are there), and each remainder takes its place by its rank among
those of its length. What rounding leaves is packed greedily by the task that holds it, cutting at window ends; the last
ids of such a task fill windows of power-of-two lengths, which need no padding.

Plan: no id is shuffled. Pass 1 tokenizes each input partition once and writes its ids to one shard file in the shared
folder, and reports (shard, remainder length, count). Pass 2 reads each shard again in the same order and places its
pieces; its closure holds the combinations (bounded by ``combinations``), its row the ranks at which the shard's lengths
start.

Defined results: null text is an empty text (the end id alone); a very long text is tokenized whole by one task and gives full
windows and a remainder; null or repeated identifiers are kept, each row a document of its own; documents of equal length
take places in the order of their shard; an empty table gives no pieces; further columns of any name are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Store, fresh, release, small_batches, unique_name
from .tokens import CACHE_ENTRIES, encoder, slices

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long"
_SHARD = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
#: Sequence ids of combinations have this bit; the others are (shard number << 32) + a running number.
_COMBINED = 1 << 60


def combine(histogram: np.ndarray, window: int, combinations: int = 60_000) -> np.ndarray:
    """Rows of up to four lengths (0: none) that sum to ``window``, over lengths that occur; at most so many rows.

    Pairs come first, then triples of the more frequent lengths and quadruples of 40 lengths spread over these, as far as the
    number goes. The bounds limit which combinations the solver may use; documents that it leaves are packed greedily.
    """
    lengths = np.flatnonzero(histogram)
    lengths = lengths[(lengths > 0) & (lengths < window)]
    has = np.zeros(2 * window, bool)
    has[lengths] = True
    half = lengths[lengths <= window // 2]
    rows = [np.stack([half, window - half, 0 * half, 0 * half], 1)[has[window - half]]]
    side = min(len(lengths), int((combinations * 2) ** 0.5))
    often = np.sort(lengths[np.argsort(-histogram[lengths], kind="stable")[:side]])
    a, b = (x.ravel() for x in np.meshgrid(often, often, indexing="ij"))
    c = window - a - b
    ok = (a <= b) & (b <= c)
    ok[ok] = has[c[ok]]
    rows.append(np.stack([a[ok], b[ok], c[ok], 0 * c[ok]], 1))
    few = often[:: max(1, len(often) // 40)]
    a, b, c = (x.ravel() for x in np.meshgrid(few, few, few, indexing="ij"))
    d = window - a - b - c
    ok = (a <= b) & (b <= c) & (c <= d)
    ok[ok] = has[d[ok]]
    rows.append(np.stack([a[ok], b[ok], c[ok], d[ok]], 1))
    return np.concatenate(rows)[:combinations]


def solve(histogram: np.ndarray, combos: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative least squares: counts x >= 0 that bring the lengths used by ``combos`` closest to ``histogram``.

    Accelerated projected gradient on the sparse system; then each count is rounded, the largest first, and lowered where a
    length would be used more often than it occurs, so the counts can be carried out.
    """
    if not len(combos):
        return np.zeros(0, np.int64)
    n, (k, slots) = len(histogram), combos.shape
    used = combos > 0
    flat, row = combos[used], np.repeat(np.arange(k), used.sum(1))
    times = lambda x: np.bincount(flat, weights=x[row], minlength=n)
    back = lambda y: np.bincount(row, weights=y[flat], minlength=k)
    v = np.ones(k)
    for _ in range(20):  # the largest eigenvalue gives the step
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top
    target = histogram.astype(float)
    target[0] = 0
    x = z = np.zeros(k)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - back(times(z) - target) / (1.01 * top))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, x = new + (was - 1) / t * (new - x), new
    counts = np.floor(x + 1e-6).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for i in np.argsort(-x, kind="stable"):  # carry out the larger counts first, as far as lengths are there
        if x[i] <= 0.05:
            break
        own, each = np.unique(combos[i][combos[i] > 0], return_counts=True)
        counts[i] = min(max(counts[i], round(x[i])), int((left[own] // each).min()))
        left[own] -= counts[i] * each
    counts[x <= 0.05] = 0
    return counts


def _places(combos: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the ranks at which its uses begin (and end), and sequence id and offset of each use's first."""
    base = np.append(0, np.cumsum(counts))[:-1]
    out: dict[int, list] = {}
    for i in np.flatnonzero(counts):
        offset = 0
        for length in combos[i]:
            if length:
                out.setdefault(int(length), []).append((int(counts[i]), int(base[i]), offset))
                offset += int(length)
    return {n: (np.append(0, np.cumsum([c for c, _, _ in u])), np.array([b for _, b, _ in u]), np.array([o for _, _, o in u])) for n, u in out.items()}


class _Greedy:
    """Windows that one task fills itself: pieces one after the other, cut at window ends, a power of two at the end."""

    def __init__(self, shard: int, window: int):
        self.next, self.window, self.open, self.held = shard << 32, window, deque(), 0

    def whole(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, piece: tuple, out: list) -> None:
        self.open.append(piece)
        self.held += piece[2]
        while self.held >= self.window:
            self._fill(self.window, out)

    def _fill(self, size: int, out: list) -> None:
        seq, offset = self.whole(), 0
        while offset < size:
            doc_id, start, length, ids, total = self.open.popleft()
            take = min(length, size - offset)
            if take < length:
                self.open.appendleft((doc_id, start + take, length - take, ids[4 * take :], total))
            out.append((doc_id, start, take, ids[: 4 * take], total, seq, offset, size))
            offset += take
        self.held -= size

    def close(self, out: list) -> None:
        while self.held:
            self._fill(min(self.window, 1 << self.held.bit_length() - 1), out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in PIECES.split(", ")])


def tokenize_shards(docs: DataFrame, root: str, tokenizer: str, end_id: int, window: int, id_col: str, text_col: str, cache: int = CACHE_ENTRIES) -> DataFrame:
    """Pass 1. A row per shard and remainder length: shard, length (0: shard without remainders too), count."""
    schema = "shard string, length int, n long"

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, name, file = encoder(tokenizer, cache), np.array([end_id], "<u4").tobytes(), unique_name("ids/part", ".arrow"), None
        counts = np.zeros(window, np.int64)
        for part in parts:
            for at, texts in slices(part.column(1)):
                raw = [x.tobytes() + end for x in encode.column(texts)]
                counts += np.bincount([len(x) // 4 % window for x in raw], minlength=window)
                if file is None:
                    out = Store(root).create(name)
                    file = pa.ipc.new_stream(out, _SHARD, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                file.write_batch(pa.RecordBatch.from_arrays([part.column(0).slice(at, len(texts)), pa.array(raw, pa.binary())], schema=_SHARD))
        if file is not None:
            file.close()
            out.close()
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["shard", "length", "n"])
        release()

    spark = docs.sparkSession
    with small_batches(spark):
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(write, schema).write.parquet(f"{root}/histogram")
    return spark.read.schema(schema).parquet(f"{root}/histogram")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, combinations: int = 60_000, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE_ENTRIES) -> DataFrame:
    """Pieces with their ids and places: see ``PIECES``. ``padded_to`` is the sequence's length as written."""
    spark = docs.sparkSession
    root = fresh(spark, "packing")
    seen = tokenize_shards(docs, root, tokenizer, end_id, window, id_col, text_col, cache)
    histogram = np.zeros(window, np.int64)
    for r in seen.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r.length] = r.n
    combos = combine(histogram, window, combinations)
    counts = solve(histogram, combos)
    places = _places(combos, counts)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    ranks = seen.withColumn("first", F.coalesce(before, F.lit(0))).groupBy("shard").agg(F.collect_list("length").alias("lengths"), F.collect_list("first").alias("firsts"))
    listed = ranks.withColumn("number", F.regexp_extract("shard", r"part-(\d+)-", 1).cast("long"))
    listed = listed.repartition(max(1, seen.select("shard").distinct().count()))  # few bytes, much work: not to be coalesced

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for part in parts:
            for row in part.to_pylist():
                rank = dict(zip(row["lengths"], row["firsts"], strict=True))
                greedy, out, held = _Greedy(row["number"], window), [], 0
                for batch in pa.ipc.open_stream(store.open(row["shard"])):
                    for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        total = len(ids) // 4
                        full = total - total % window
                        for start in range(0, full, window):
                            out.append((doc_id, start, window, ids[4 * start : 4 * (start + window)], total, greedy.whole(), 0, window))
                        if length := total % window:
                            r, tail = rank[length], ids[4 * full :]
                            rank[length] = r + 1
                            use = places.get(length)
                            if use is not None and r < use[0][-1]:
                                i = int(np.searchsorted(use[0], r, "right")) - 1
                                out.append((doc_id, full, length, tail, total, _COMBINED + int(use[1][i]) + r - int(use[0][i]), int(use[2][i]), window))
                            else:
                                greedy.add((doc_id, full, length, tail, total), out)
                        held += len(ids)
                        if held > 4 << 20 and out:
                            yield _batch(out)
                            out, held = [], 0
                greedy.close(out)
                if out:
                    yield _batch(out)

    return listed.mapInArrow(place, PIECES)


def digest(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, cache: int = CACHE_ENTRIES) -> DataFrame:
    """Pieces with a CRC-32 in place of their ids."""
    out = pack(docs, tokenizer, end_id, window, cache=cache)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")
