"""Token-id table: documents keyed by identifier in sorted-string-table shards (operator 6).

A shard holds the documents of one key range in ascending key order::

    block*            zstd; entries: varint(shared key bytes), varint(own key bytes), varint(value bytes), key, value
    Bloom filter      bit array over all keys of the shard
    block index       zstd; per block: varint(key bytes), first key, varint(offset), varint(bytes)
    footer            offsets and sizes of filter and index, hash count, entries, magic (fixed size)

A value is one byte for the id width (2 or 4) and the ids, little-endian. A point lookup picks the shard by key range, asks
the Bloom filter, binary-searches the sparse block index and reads one block.

Plan: documents are dealt by key range once (raw text, less than their ids), sorted inside each range, and tokenized and
written by the task that holds the range. Only a manifest row per shard (key range, counts) reaches the driver, for the
running number of ids before each shard.

Defined results: null text is an empty text (its ids are the end id alone); a very long text is one entry, and so one block, held
whole by one task; a null identifier is a key of its own, before all others; repeated identifiers are kept as separate
entries, in order of their text's hash and text, and may fill several shards; rows equal in both are entries one after the
other in one shard (their order cannot matter, but a range cannot part them: such rows are one task's, however many); an
empty table gives no shards; further columns of any name are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Store, fresh, release, small_batches, unique_name
from .tokens import encoder, slices

MAGIC = b"SLTOK001"
_FOOTER = struct.Struct("<QQQQIQ8s")
_HALF = 1 << 63
MANIFEST = "shard string, first_key binary, last_key binary, n_docs long, n_ids long"
ENTRIES = "doc_id long, start long, n_tokens long, ids binary"


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as identifiers do, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + _HALF)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - _HALF


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        n, at, shift = n | (x & 127) << shift, at + 1, shift + 7
        if x < 128:
            return n, at


def _bloom_bits(key: bytes, hashes: int, bits: int) -> list[int]:
    h1, h2 = zlib.crc32(key), zlib.adler32(key) * 2654435761 % (1 << 32) | 1
    return [(h1 + i * h2) % bits for i in range(hashes)]


class ShardWriter:
    """Takes entries in key order (``width``: bytes that every id fits, if known); holds one block, the sparse index and the keys' hashes in memory."""

    def __init__(self, out, block_bytes: int = 1 << 18, width: int | None = None):
        self.out, self.block_bytes, self.width, self.at = out, block_bytes, width, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index, self.keys, self.zip = [], [], zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        width = self.width or (2 if not len(ids) or int(ids.max()) < 65536 else 4)
        value = bytes([width]) + ids.astype(f"<u{width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _write(self, b: bytes) -> tuple[int, int]:
        self.out.write(b)
        self.at += len(b)
        return self.at - len(b), len(b)

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.first, *self._write(self.zip.compress(bytes(self.block)))))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits, hashes = max(64, -(-10 * len(self.keys) // 8) * 8), 7
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_bloom_bits(key, hashes, bits)] = True
        b = self._write(np.packbits(bloom).tobytes())
        i = self._write(self.zip.compress(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)))
        self._write(_FOOTER.pack(*b, *i, hashes, len(self.keys), MAGIC))
        self.out.close()


class ShardReader:
    """Reads footer, filter and block index; blocks by range."""

    def __init__(self, file):
        self.file, size = file, file.size()
        b_at, b_n, i_at, i_n, self.hashes, self.entries, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table shard")
        self.bloom = np.frombuffer(file.read_at(b_n, b_at), np.uint8)
        raw, at, self.index = zstandard.decompress(file.read_at(i_n, i_at)), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            self.index.append((key, offset, size))

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, size = self.index[i]
        raw, at, key = zstandard.decompress(self.file.read_at(size, offset)), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key, at = key[:shared] + raw[at : at + own], at + own
            yield key, np.frombuffer(raw, f"<u{raw[at]}", (n - 1) // raw[at], at + 1)
            at += n

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def find(self, key: bytes) -> list[np.ndarray]:
        """The ids stored under a key; several if it repeats, none if it is absent."""
        for bit in _bloom_bits(key, self.hashes, len(self.bloom) * 8):
            if not self.bloom[bit >> 3] >> (7 - (bit & 7)) & 1:
                return []
        firsts, out = [k for k, _, _ in self.index], []
        i = max(0, bisect.bisect_left(firsts, key) - 1)  # the key's first entry may end the block before
        while i < len(self.index) and firsts[i] <= key:
            out += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return out


def write_table(docs: DataFrame, root: str, tokenizer: str, end_id: int, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards below ``root`` and return the manifest, a row per shard, itself stored below ``root``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard, first, n_ids, encode = unique_name("shards/part", ".sst"), None, b"", 0, encoder(tokenizer)
        end, width = np.array([end_id], "<u4"), 2 if max(end_id, len(encode.marks) - 1) < 65536 else 4
        for part in parts:
            ids = part.column(0).to_pylist()
            for at, texts in slices(part.column(1)):
                for doc_id, values in zip(ids[at : at + len(texts)], encode.column(texts), strict=True):
                    key = key_of(doc_id)
                    if shard is None:
                        shard, first = ShardWriter(Store(root).create(name), width=width), key
                    shard.add(key, np.concatenate([values, end]))
                    n_ids += len(values) + 1
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pydict({"shard": [name], "first_key": [first], "last_key": [shard.last], "n_docs": [len(shard.keys)], "n_ids": [n_ids]})
        release()

    with small_batches(spark):
        dealt.mapInArrow(write, MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _shards(spark: SparkSession, root: str) -> list[tuple]:
    """Shards in key order with the ids before each; as many rows as there are shards, never documents."""
    rows = sorted(spark.read.schema(MANIFEST).parquet(f"{root}/manifest").collect(), key=lambda r: (bytes(r.first_key), bytes(r.last_key), r.shard))
    out, base = [], 0
    for r in rows:
        out.append((r.shard, bytes(r.first_key), bytes(r.last_key), base))
        base += r.n_ids
    return out


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """All entries from the files: doc_id, start (ids before the document), n_tokens, ids (little-endian unsigned 32-bit)."""
    shards = _shards(spark, root)
    listed = spark.createDataFrame([(s, base) for s, _, _, base in shards], "shard string, base long").repartition(max(1, len(shards)))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for part in parts:
            for name, at in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for key, ids in ShardReader(store.open(name)).scan():
                    rows.append((id_of(key), at, len(ids), ids.astype("<u4").tobytes()))
                    at, held = at + len(ids), held + 4 * len(ids)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return listed.mapInArrow(read, ENTRIES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def lookup(spark: SparkSession, root: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Point lookups: doc_id, ids for each key that the table holds. The task's closure has a row per shard."""
    shards = _shards(spark, root)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, open_, lasts = Store(root), {}, [last for _, _, last, _ in shards]
        for part in parts:
            found = []
            for doc_id in part.column(0).to_pylist():
                key = key_of(doc_id)
                i = bisect.bisect_left(lasts, key)
                while i < len(shards) and shards[i][1] <= key:
                    if i not in open_:
                        open_.clear()  # keys come sorted: one shard at a time
                        open_[i] = ShardReader(store.open(shards[i][0]))
                    found += [(doc_id, ids.astype("<u4").tobytes()) for ids in open_[i].find(key)]
                    i += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.binary())], ["doc_id", "ids"])

    return keys.select(F.col(id_col).cast("long").alias("doc_id")).distinct().sortWithinPartitions("doc_id").mapInArrow(find, "doc_id long, ids binary")


def crc_of(ids: Column) -> Column:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return F.crc32(ids)


def digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs``, read the files back, and describe each document: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    root = fresh(spark, "token-table")
    write_table(docs, root, tokenizer, end_id)
    return read_table(spark, root).select("doc_id", "start", "n_tokens", crc_of(F.col("ids")).alias("ids_crc32"))
