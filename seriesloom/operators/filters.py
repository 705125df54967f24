"""Membership filters: a Bloom filter per partition, and a cuckoo filter that can forget.

Stored filters are rows of 32,768 bits (pid, bucket, bitmap) that the JVM's bitmap aggregates build, unite and intersect, so a
partition of any size is reduced in many tasks; a filter's size follows from its partition's distinct keys. A probe is joined
with the few bitmaps that hold its bits. Filters of equal size unite and intersect. Empty partitions have no filter, which
means that nothing is in them. ``bloom_bits`` and ``bloom_contains`` are the same filter as bytes, for one process.
"""

from __future__ import annotations

import math
import random
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions.representation import bloom_key

BLOOM = "pid int, bucket long, bitmap binary, m long, h int, n long"


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) for n items at a false positive rate."""
    if n < 1 or not 0 < rate < 1:
        raise ValueError("need items and a rate between 0 and 1")
    m = math.ceil(-n * math.log(rate) / math.log(2) ** 2)
    return m, max(1, math.ceil(m // n * math.log(2)))


def bloom_positions(h1: np.ndarray, h2: np.ndarray, m: int, h: int) -> np.ndarray:
    """Bit positions (items, hashes) from two 64-bit hashes of each item."""
    a, b = h1.astype(np.uint64) % np.uint64(m), h2.astype(np.uint64) % np.uint64(m)
    return (a[:, None] + np.arange(h, dtype=np.uint64) * b[:, None]) % np.uint64(m)


def wide_positions(h1: np.ndarray, h2: np.ndarray, m: int, h: int) -> np.ndarray:
    """The same from a 128-bit hash (h1, h2): the sums wrap at 64 bits before they are brought into range."""
    with np.errstate(over="ignore"):
        mixed = h1.astype(np.uint64)[:, None] + np.arange(h, dtype=np.uint64) * h2.astype(np.uint64)[:, None]
    return (mixed >> np.uint64(1)) % np.uint64(m)


def bloom_bits(h1: np.ndarray, h2: np.ndarray, m: int, h: int) -> bytes:
    bits = np.zeros(m, bool)
    bits[bloom_positions(h1, h2, m, h).ravel()] = True
    return np.packbits(bits).tobytes()


def bloom_contains(bits: bytes, m: int, h: int, h1: int, h2: int) -> bool:
    at = bloom_positions(np.array([h1], np.int64).view(np.uint64), np.array([h2], np.int64).view(np.uint64), m, h)[0]
    raw = np.frombuffer(bits, np.uint8)
    return bool(np.all(raw[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1))


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def _places(m: Column, h: Column) -> Column:
    """The bits (from 1) of the hashes h1 and h2 in a filter of m bits."""
    half = lambda c: F.shiftrightunsigned(c, 34)  # noqa: E731  small enough that sums do not overflow
    return F.transform(F.sequence(F.lit(0), h - 1), lambda i: F.pmod(half("h1") + i * half("h2"), m) + 1)


def bloom_table(rows: DataFrame, cfg: IndexConfig, m: int | None = None) -> DataFrame:
    """A filter per pid (``BLOOM``) over the keys of (pid, word[, values]); ``m`` fixes the size, so that filters can be combined."""
    key = bloom_key(F.col("word"), F.col("values") if cfg.bloom_features else F.col("word"), cfg.bloom_features)
    h1, h2 = hashes(key)
    keys = rows.select("pid", h1.alias("h1"), h2.alias("h2")).distinct()
    sizes = keys.groupBy("pid").agg(F.count("*").alias("n"))  # a row per partition
    bits = F.lit(m).cast("long") if m is not None else F.ceil(F.col("n") * (-math.log(cfg.bloom_rate) / math.log(2) ** 2)).cast("long")
    many = F.greatest(F.lit(1), F.ceil(F.floor(F.col("m") / F.col("n")) * math.log(2))).cast("int")
    sizes = sizes.withColumn("m", bits).withColumn("h", F.lit(max(1, math.ceil(-math.log2(cfg.bloom_rate)))) if m is not None else many)
    at = keys.join(F.broadcast(sizes), "pid").select("pid", "m", "h", "n", F.explode(_places(F.col("m"), F.col("h"))).alias("at"))
    out = at.groupBy("pid", "m", "h", "n", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    return out.select("pid", "bucket", "bitmap", "m", "h", "n")


def might_contain(probes: DataFrame, blooms: DataFrame) -> DataFrame:
    """``probes`` (pid, key, ...) with ``maybe``; false where a partition has no filter."""
    h1, h2 = hashes(F.col("key"))
    sizes = blooms.select("pid", "m", "h").distinct()
    asked = probes.select("pid", "key").distinct().join(F.broadcast(sizes), "pid").withColumns({"h1": h1, "h2": h2})
    bits = asked.select("pid", "key", "h", F.explode(F.array_distinct(_places(F.col("m"), F.col("h")))).alias("at"), F.size(F.array_distinct(_places(F.col("m"), F.col("h")))).alias("need"))
    bits = bits.withColumns({"bucket": F.bitmap_bucket_number("at"), "bit": F.bitmap_bit_position("at")})
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = (F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)), F.lit(2)) == 1)
    there = bits.join(blooms.select("pid", "bucket", "bitmap"), ["pid", "bucket"]).where(is_set)
    found = there.groupBy("pid", "key", "need").agg(F.count("*").alias("got")).where(F.col("got") == F.col("need")).select("pid", "key", F.lit(True).alias("maybe"))
    return probes.join(found, ["pid", "key"], "left").withColumn("maybe", F.coalesce("maybe", F.lit(False))).select(*probes.columns, "maybe")


def read_filter(spark: SparkSession, path: str, pid: int) -> DataFrame:
    """One partition's stored filter; the literal partition filter opens no other."""
    return spark.read.schema(BLOOM).parquet(path).where(F.col("pid") == pid)


def united(blooms: DataFrame) -> DataFrame:
    """(bucket, bitmap): the union of filters of equal size and hashes."""
    _equal(blooms)
    return blooms.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def intersected(blooms: DataFrame) -> DataFrame:
    """(bucket, bitmap): the intersection of filters of equal size and hashes; a bucket that one of them lacks is empty."""
    _equal(blooms)
    filters_ = blooms.select("pid").distinct().count()
    held = blooms.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count_distinct("pid").alias("n"))
    return held.where(F.col("n") == filters_).select("bucket", "bitmap")


def _equal(blooms: DataFrame) -> None:
    if blooms.select("m", "h").distinct().limit(2).count() > 1:
        raise ValueError("filters of different sizes cannot be combined")


def combine(a: bytes, b: bytes, union: bool = True) -> bytes:
    """Union or intersection of filters of equal size and hashes."""
    if len(a) != len(b):
        raise ValueError("filters of different sizes cannot be combined")
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    return (x | y if union else x & y).tobytes()


def expected_rate(bits: bytes, m: int, h: int) -> float:
    """False positive rate from the share of bits that are set."""
    return (int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum()) / m) ** h


class CuckooFilter:
    """Set of 64-bit hashes with removal: 16-bit tags, four to a bucket. A full filter raises rather than drop an item."""

    SLOTS, KICKS = 4, 500

    def __init__(self, items: int, seed: int = 0):
        need = max(1, math.ceil(items / 0.95 / self.SLOTS))
        self.buckets = 1 << (need - 1).bit_length()
        self.tags = np.zeros((self.buckets, self.SLOTS), np.uint16)
        self.random, self.size = random.Random(seed), 0

    def _home(self, item: int) -> tuple[int, int]:
        x = item & (1 << 64) - 1
        return (x >> 16) % self.buckets, (x & 0xFFFF) or 1

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ (tag * 0x5BD1E995) % self.buckets

    def _put(self, bucket: int, tag: int) -> bool:
        free = np.flatnonzero(self.tags[bucket] == 0)
        if len(free):
            self.tags[bucket, free[0]] = tag
        return len(free) > 0

    def add(self, item: int) -> None:
        bucket, tag = self._home(item)
        if not self._put(bucket, tag):
            bucket = self._other(bucket, tag)
            undo = []
            while not self._put(bucket, tag):
                if len(undo) == self.KICKS:
                    for b, slot, old in reversed(undo):
                        self.tags[b, slot] = old
                    raise OverflowError("the cuckoo filter is full")
                slot = self.random.randrange(self.SLOTS)
                undo.append((bucket, slot, int(self.tags[bucket, slot])))
                tag, self.tags[bucket, slot] = int(self.tags[bucket, slot]), tag
                bucket = self._other(bucket, tag)
        self.size += 1

    def __contains__(self, item: int) -> bool:
        bucket, tag = self._home(item)
        return bool((self.tags[bucket] == tag).any() or (self.tags[self._other(bucket, tag)] == tag).any())

    def remove(self, item: int) -> bool:
        bucket, tag = self._home(item)
        for b in (bucket, self._other(bucket, tag)):
            at = np.flatnonzero(self.tags[b] == tag)
            if len(at):
                self.tags[b, at[0]] = 0
                self.size -= 1
                return True
        return False

    def to_bytes(self) -> bytes:
        return struct.pack("<QQ", self.buckets, self.size) + self.tags.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "CuckooFilter":
        out = cls(1)
        out.buckets, out.size = struct.unpack("<QQ", raw[:16])
        out.tags = np.frombuffer(raw[16:], np.uint16).reshape(out.buckets, cls.SLOTS).copy()
        return out
