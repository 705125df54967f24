r"""Near-duplicate groups by bottom-k sketches and exact Jaccard similarity (operator 8).

A document's set is its distinct 5-word shingles (words ``[^\x20\x09-\x0D]+``, A-Z lower-cased; fewer words: the whole
sequence). Documents are linked if ``100 * intersection >= 85 * union``; groups are the components of these links.

1. Equal sets are one class; what follows works on one member of each.
2. A sketch holds a class's ``RETAINED`` smallest shingle hashes (one hash function, the upper 31 bits of each). Two linked
   sets share at least ``need(s)`` of the s values that one of them retains: exactly so if neither was cut, else but for a
   chance below 1e-9 (binomial tail).
3. Inverted lists of the ``LISTED`` smallest values. Ordered from the rarest value, any two linked sketches meet within
   their first ``s - need(s) + 1`` values, so only those are listed: passages that many documents share come last.
4. Classes that lists connect form families. A family is cut into blocks; each pair of blocks meets in one task, which has
   their sketches alone: overlaps, then union-sketch estimates, of every pair across the blocks say which classes have
   a partner that may be linked (again but for a chance below 1e-9).
5. Texts are fetched for those classes alone and meet in the same pairs of blocks, where full sets decide. A task
   returns the links of a spanning forest of what it found, never all pairs.
6. Components of these links, over blocks and families.

Plan: of texts, only those of classes with a likely partner move, once, and once more for each pair of blocks that needs
them; lists and links are joined on their keys with partial aggregation or skew-splitting joins. Blocks bound what a task
holds, in classes (``BLOCK``) and in shingles (``BLOCK_SHINGLES``; a longer text is a block of its own), however large a
family is. A family of n classes costs n * n / BLOCK sketches (of a kilobyte), the one term that is not linear: it is
the price of losing no link among documents that share rare values. Nothing grows on the driver.

Defined results: null, empty or wordless text has an empty set and is a group of its own, kept; a text of any length is one
set, made by one task; exact copies share a group; component_id is the smallest identifier of the group that is not null
(null if all are); rows of equal identifier get equal component ids only if their texts are linked, and ``kept`` is true for
each row that bears its group's identifier, repeated rows included; an empty table gives an empty result; further columns
of any name are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import cut, dropped, hinted, release, small_batches
from .shingles import shingle_sets

SKETCH = "doc_id long, h long, n_shingles long, fp binary, sketch array<int>"
#: Values of a sketch, for estimates, and how many of them, the smallest, have inverted lists.
RETAINED, LISTED = 256, 128
#: Classes of a block, two of which meet in one task, and shingles of all its sets together (8 bytes each).
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Members of families up to which their keys are broadcast to fetch texts (about 50 bytes each).
BROADCAST_ROWS = 200_000
#: The same of two numbers each: classes with their families.
FAMILY_ROWS = 1_000_000
#: Classes that a task compares, about.
TASK_ROWS = 1_000


def need(s: int, k: int, percent: int = 85, chance: float = 1e-9) -> int:
    """Least number of retained values that two linked sketches share, one of which has s of at most k values.

    One less from 32 values on, since two hashes of a set may agree in the bits that are kept.
    """
    p, spare = percent / 100, int(s >= 32)
    if s < math.floor(p * k) or s == 1:  # neither set was cut
        return max(1, -(-percent * s // 100) - spare)
    tail = 0.0
    for m in range(s + 1):
        tail += math.comb(s, m) * p**m * (1 - p) ** (s - m)
        if tail > chance:
            return max(1, m - spare)
    return max(1, s - spare)


def sketch_of(s: np.ndarray, k: int = RETAINED) -> np.ndarray:
    """A sketch from a set's sorted hashes: the k smallest, their upper 31 bits, ascending."""
    return np.unique(s[:k] >> np.uint64(33)).astype(np.int32)


def sketches(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SKETCH`` for each row: identifier, text hash, set size, set fingerprint (null: empty), retained values."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, fps, values = [], [], []
            for s in shingle_sets(part.column(2).to_pylist(), size):
                n.append(len(s))
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                values.append(sketch_of(s))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(values, pa.list_(pa.int32()))], ["doc_id", "h", "n_shingles", "fp", "sketch"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).mapInArrow(run, SKETCH)


def families(classes: DataFrame, percent: int) -> DataFrame:
    """(node, family) of classes (node, sketch) that inverted lists connect with others."""
    listed = classes.select("node", F.least(F.size("sketch"), F.lit(LISTED)).alias("s"), F.slice("sketch", 1, LISTED).alias("sketch"))
    posts = listed.select("node", "s", F.explode("sketch").alias("value"))
    counts = posts.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    shared = posts.join(counts, "value").groupBy("node", "s").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("line"))
    first = F.array(*(F.lit(s - need(s, LISTED, percent) + 1) for s in range(1, LISTED + 1)))
    single = F.col("s") - F.size("line")  # values of no other class are the rarest
    room = F.greatest(F.get(first, F.col("s") - 1) - single, F.lit(0))
    lists = cut(shared.select("node", F.explode(F.slice("line", F.lit(1), room)).alias("p")).select("node", F.col("p.value").alias("value")), "lists")
    hubs = lists.groupBy("value").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = cut(lists.join(hubs, "value").select("node", "hub").distinct(), "hubs")
    out = components(edges, "node", "hub").withColumnRenamed("root", "family")
    dropped(lists, edges)
    return out


def cells(members: DataFrame) -> tuple[DataFrame, int]:
    """``members`` (family, fp, n_shingles, ...), once for each pair (i, j) of its family's blocks that its block ``own`` is in,
    and how many rows that makes."""
    sized = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    sized = sized.select("family", "n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    count = sized.agg(F.sum(F.col("n") * F.col("blocks")).alias("n")).first().n or 0
    rows = members.join(sized.drop("n"), "family").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j"))))
    return rows.withColumn("cell", pair).select(*members.columns, "own", "cell.i", "cell.j"), count


def estimate(a: np.ndarray, b: np.ndarray, k: int = RETAINED) -> float:
    """Jaccard similarity from two sketches: the share of the union's k smallest values that both hold."""
    union = np.union1d(a, b)[:k]
    return float((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).mean())


@functools.cache
def _thresholds(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least overlap of two linked sketches, by the size of one, and least shared part of their union's sketch, by its size."""
    sizes = range(1, RETAINED + 1)
    overlaps = [0, *(need(x, RETAINED, percent) for x in sizes)]
    estimates = [0, *(need(x, x if x == RETAINED else 2 * RETAINED, percent) for x in sizes)]
    return np.array(overlaps), np.array(estimates)


def likely(sketches_: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Which sketches have a partner that the union-sketch estimate does not rule out; with two sides, one of the other side."""
    n, k, two = len(sketches_), RETAINED, len(np.unique(side)) > 1
    sizes = np.array([len(x) for x in sketches_])
    overlaps, estimates = _thresholds(percent)
    values, inverse = np.unique(np.concatenate(sketches_), return_inverse=True)
    place, at = np.full((n, k), len(values)), 0
    for i, x in enumerate(sizes.tolist()):
        place[i, :x] = inverse[at : at + x]
        at += x
    rank, own = np.full(len(values) + 1, -1, np.int32), np.arange(k, dtype=np.int32)
    few = overlaps[sizes]
    out = np.zeros(n, bool)
    for i in range(n):
        if out[i]:
            continue
        rank[place[i, : sizes[i]]] = own[: sizes[i]]
        other = rank[place]
        both = other >= 0
        overlap = both.sum(1)
        ok = overlap >= np.maximum(few, few[i])
        ok[i] = False
        if two:
            ok &= side != side[i]
        js = np.flatnonzero(ok)
        if len(js):
            shared = both[js]
            place_in_union = other[js] + own - (np.cumsum(shared, axis=1) - shared)
            size = np.minimum(k, sizes[js] + sizes[i] - overlap[js])
            held = (shared & (place_in_union < size[:, None])).sum(1)
            js = js[held >= estimates[size]]
            if len(js):
                out[js] = out[i] = True
        rank[place[i, : sizes[i]]] = -1
    return out


def _per_cell(rows: DataFrame, count: int, schema: str, columns: list[str], work) -> DataFrame:
    """``work`` on the rows (family, i, j, ``columns``), ``count`` of them, of each cell, lists by column; it returns lists by
    column of ``schema``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> list[list]:
            return work(key, [list(c) for c in zip(*held, strict=True)]) if len(held) > 1 else []

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        batch = lambda found: pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(found, schema.split(", "), strict=True)], names)
        for part in parts:
            keys = list(zip(*(c.to_pylist() for c in part.columns[:3]), strict=True))
            rest = list(zip(*(part.column(i + 3) if columns[i] == "sketch" else part.column(i + 3).to_pylist() for i in range(len(columns))), strict=True))
            for cell, row in zip(keys, rest, strict=True):
                if cell != key:
                    found = close()
                    if found and found[0]:
                        yield batch(found)
                    key, held = cell, []
                held.append(row)
        found = close()
        if found and found[0]:
            yield batch(found)
        held.clear()
        release()

    rows = rows.select("family", "i", "j", *columns)
    tasks = max(1, -(-count // TASK_ROWS))  # much work on few bytes: not to be coalesced by size
    return rows.repartition(tasks, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(run, schema)


def alike(members: DataFrame, percent: int) -> DataFrame:
    """(family, i, j, fp): classes (family, fp, n_shingles, sketch) with a likely partner, and the pair of blocks it is in."""

    def work(key: tuple, columns: list[list]) -> list[list]:
        fps, own, held = columns
        found = np.flatnonzero(likely([x.values.to_numpy() for x in held], np.array(own), percent))
        return [*([x] * len(found) for x in key), [fps[i] for i in found]]

    return _per_cell(*cells(members), "family long, i int, j int, fp binary", ["fp", "own", "sketch"], work)


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (member, root) of a spanning forest of the pairs of sets that are linked, by their full overlaps."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    often = count[code] > 1  # what one set alone has is in no overlap
    row, code = row[often], code[often]
    begin, every = np.searchsorted(row, np.arange(n + 1)), code
    free, mark, out = np.ones(n, bool), np.zeros(len(count), bool), []
    for root in range(n):
        if not free[root]:
            continue
        free[root], todo = False, [root]
        while todo and free.any():
            x = todo.pop()
            here = free[row]
            if 2 * here.sum() < len(row):  # entries of sets that are reached are not looked at again
                row, code = row[here], code[here]
            own = every[begin[x] : begin[x + 1]]
            mark[own] = True
            both = np.bincount(row[mark[code]], minlength=n)
            mark[own] = False
            new = np.flatnonzero(free & (both > 0) & (100 * both >= percent * (sizes + sizes[x] - both)))
            free[new] = False
            todo += new.tolist()
            out += [(int(y), root) for y in new]
    return out


def links(held: DataFrame, count: int, size: int, percent: int) -> DataFrame:
    """(a, b): links that connect what is linked in each pair of blocks (family, i, j, fp, text), of ``count`` rows."""

    def work(key: tuple, columns: list[list]) -> list[list]:
        fps, texts = columns
        found = forest(list(shingle_sets(texts, size)), percent)
        return [[fps[a] for a, _ in found], [fps[b] for _, b in found]]

    return _per_cell(held, count, "a binary, b binary", ["fp", "text"], work)


def assign(docs: DataFrame, percent: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, h (hash of the text), n_shingles, component_id, kept."""
    with small_batches(docs.sparkSession):  # all that runs in Python is done before it returns
        return _assigned(docs, percent, size, id_col, text_col)


def _assigned(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    rows = cut(sketches(docs, size, id_col, text_col), "sketches")
    classes = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("member"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", F.xxhash64("fp")), "classes")
    family = families(classes.select("node", "sketch"), percent)
    members = cut(classes.select("node", "fp", "n_shingles", "sketch", F.col("member.doc_id").alias("d"), F.col("member.h").alias("mh")).join(hinted(cut(family, "families"), FAMILY_ROWS), "node").drop("node"), "members")
    near = cut(alike(members, percent), "alike")
    wanted = cut(members.select("fp", "d", "mh").join(near.select("fp").distinct(), "fp", "left_semi"), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    held = texts.join(hinted(wanted, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("mh"))).select("fp", "text")
    held = cut(held.dropDuplicates(["fp"]), "texts")
    edges = cut(links(near.join(held, "fp"), near.count(), size, percent), "links")
    linked = components(edges, "a", "b")
    own = classes.select("fp", "least")
    found = linked.join(own, F.col("node") == F.col("fp")).select("root", "fp", "least")
    named = cut(found.groupBy("root").agg(F.min("least").alias("component_id")).join(found, "root").select("fp", "component_id"), "named")
    class_ids = own.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    dropped(members, near, wanted, held, edges)
    worded = rows.where("fp is not null").join(class_ids, "fp").select("doc_id", "h", "n_shingles", "component_id")
    empty = rows.where("fp is null").select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id"))
    return worded.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def groups(docs: DataFrame, **parameters) -> DataFrame:
    """:func:`assign` without the texts' hashes."""
    return assign(docs, **parameters).drop("h")


#: DuckDB: all pairs that share a shingle, and the closure of the links.
SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), sets as (
  select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as s from words
), flat as (
  select doc_id, len(s) as n, unnest(s) as g from sets
), pairs as (
  select a.doc_id as a, b.doc_id as b from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges as (
  select a, b from pairs union all select b, a from pairs
), reach as (
  select doc_id, doc_id as c from sets union select e.b, r.c from reach r join edges e on e.a = r.doc_id
)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.c) as component_id, s.doc_id = min(r.c) as kept
from sets s join reach r using (doc_id) group by s.doc_id, len(s.s)
"""
