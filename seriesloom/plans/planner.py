"""From prefix counts to partitions: the global tree, and packing of siblings by first fit decreasing.

The tree holds nodes whose parent is larger than a partition, a number that goes with data size over partition size, so it
is planned on the driver. Records that a sample did not show have the overflow partition, which is numbered last and is a
candidate of every search.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions.distance import bounds_to, boxes
from ..functions.representation import prefix


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def layer_counts(counts: DataFrame, cfg: IndexConfig, least: float | None = None) -> DataFrame:
    """(level, prefix, cnt) of all prefixes, in one pass over the distinct words; with ``least``, of those whose parent has more."""
    levels = F.explode(F.sequence(F.lit(1), F.lit(cfg.bits)))
    rows = counts.select("word", "cnt", levels.alias("level"))
    out = rows.groupBy("level", F.substring("word", F.lit(1), F.col("level") * cfg.digits).alias("prefix")).agg(F.sum("cnt").alias("cnt"))
    if least is None:
        return out
    big = out.where(F.col("cnt") > least).select((F.col("level") + 1).alias("level"), F.col("prefix").alias("parent"))
    deeper = out.where("level > 1").withColumn("parent", F.substring("prefix", F.lit(1), (F.col("level") - 1) * cfg.digits))
    return out.where("level = 1").unionByName(deeper.join(big, ["level", "parent"], "left_semi").drop("parent"))


@dataclass
class Node:
    prefix: str
    count: int
    children: list["Node"] = field(default_factory=list)
    pids: list[int] = field(default_factory=list)
    leaf: bool = False


def first_fit(nodes: list[Node], size: int) -> list[list[Node]]:
    """Bins of nodes, largest first, each into the first bin with room; ties by prefix."""
    bins: list[tuple[int, list[Node]]] = []
    for n in sorted(nodes, key=lambda n: (-n.count, n.prefix)):
        for i, (used, held) in enumerate(bins):
            if used + n.count <= size:
                bins[i] = (used + n.count, [*held, n])
                break
        else:
            bins.append((n.count, [n]))
    return [held for _, held in bins]


@dataclass
class GlobalIndex:
    """The planned tree: look-ups of partitions by word, by sibling and by bound."""

    cfg: IndexConfig
    nodes: dict[str, Node]
    partitions: int
    edges: tuple | None = None

    @property
    def overflow(self) -> int:
        return self.partitions

    def leaves(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.leaf]

    def leaf_of(self, word: str) -> Node | None:
        for level in range(1, self.cfg.bits + 1):
            n = self.nodes.get(word[: level * self.cfg.digits])
            if n is None or n.leaf:
                return n
        return None

    def pid(self, word: str) -> int:
        leaf = self.leaf_of(word)
        return leaf.pids[0] if leaf else self.overflow

    def siblings(self, word: str) -> list[int]:
        """Partitions below the parent of the word's leaf; for an unknown word those of the deepest node on its path."""
        leaf = self.leaf_of(word)
        if leaf:
            return self.nodes[leaf.prefix[: -self.cfg.digits]].pids
        level = self.cfg.bits
        while level and word[: level * self.cfg.digits] not in self.nodes:
            level -= 1
        return sorted({*self.nodes[word[: level * self.cfg.digits]].pids, self.overflow})

    def by_count(self, word: str, k: int) -> list[int]:
        """Partitions of the deepest node on the word's path that holds more than k records."""
        best = self.nodes[""]
        for level in range(1, self.cfg.bits + 1):
            n = self.nodes.get(word[: level * self.cfg.digits])
            if n is None or n.count <= k:
                break
            best = n
        return best.pids

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower and upper edges of the leaves, and their partitions."""
        if self.edges is None:  # once a tree: two numbers a leaf and segment
            leaves = self.leaves()
            self.edges = (*boxes([n.prefix for n in leaves], self.cfg), np.array([n.pids[0] for n in leaves], int))
        return self.edges

    def within(self, lower: np.ndarray, upper: np.ndarray, radius: float) -> list[int]:
        """Partitions with a leaf whose bound is at most ``radius``, and the overflow."""
        lo, hi, pids = self.boxes()
        return sorted({*np.unique(pids[bounds_to(lo, hi, lower, upper, self.cfg) <= radius]).tolist(), self.overflow})

    def within_any(self, lowers: np.ndarray, uppers: np.ndarray, radius: float) -> list[int]:
        """Partitions within the radius of one or more queries (rows), and the overflow."""
        lo, hi, pids = self.boxes()
        left = np.ones(len(pids), bool)
        for lower, upper in zip(lowers, uppers, strict=True):
            at = np.flatnonzero(left)
            if not len(at):
                break
            left[at[bounds_to(lo[at], hi[at], lower, upper, self.cfg) <= radius]] = False
        return sorted({*np.unique(pids[~left]).tolist(), self.overflow})

    def pid_column(self, w: Column) -> Column:
        """Partition of a word column for small trees; :func:`assign` joins for large ones."""
        out = None
        for level in sorted({len(n.prefix) for n in self.leaves()}):
            pairs = [x for n in self.leaves() if len(n.prefix) == level for x in (F.lit(n.prefix), F.lit(n.pids[0]))]
            found = F.create_map(*pairs)[F.substring(w, 1, level)]
            out = found if out is None else F.coalesce(out, found)
        return F.coalesce(out, F.lit(self.overflow)) if out is not None else F.lit(self.overflow)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n.prefix, len(n.prefix) // self.cfg.digits, n.count, n.leaf, n.pids) for _, n in sorted(self.nodes.items())]
        return spark.createDataFrame(rows, "prefix string, level int, est_cnt long, is_leaf boolean, pids array<int>")

    def render(self) -> str:
        """The tree as indented lines."""
        return "\n".join(f"{'  ' * (len(p) // self.cfg.digits)}{p or 'root'} {n.count} {'leaf' if n.leaf else 'stem'} {n.pids}" for p, n in sorted(self.nodes.items()))

    @classmethod
    def parse(cls, text: str, cfg: IndexConfig) -> "GlobalIndex":
        """The tree that :meth:`render` wrote."""
        rows = []
        for line in text.splitlines():
            prefix, count, kind, pids = line.split(None, 3)
            rows.append(("" if prefix == "root" else prefix, int(count), kind == "leaf", json.loads(pids)))
        return _from_rows(rows, cfg)


def plan(rows: list[tuple[str, int]], cfg: IndexConfig, fraction: float = 1.0) -> GlobalIndex:
    """Partitions for prefixes and (sampled) counts. The root is always split; a node without children, however large,
    gets a partition of its own; siblings that fit together share one."""
    nodes: dict[str, Node] = {"": Node("", 0)}
    for p, n in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        nodes[p] = Node(p, round(n / fraction))
    for p in sorted(nodes, key=len, reverse=True):  # ancestors that a sample left out carry their children's count
        if p and p[: -cfg.digits] not in nodes:
            missing = p[: -cfg.digits]
            while missing not in nodes:
                nodes[missing] = Node(missing, 0)
                missing = missing[: -cfg.digits]
    for p in sorted(nodes, key=lambda p: (-len(p), p)):
        if p:
            nodes[p[: -cfg.digits]].children.append(nodes[p])
    for p in sorted(nodes, key=len, reverse=True):
        n = nodes[p]
        n.children.sort(key=lambda c: c.prefix)
        n.count = n.count or sum(c.count for c in n.children)
    nodes[""].count = sum(c.count for c in nodes[""].children)
    kept, pid = {"": nodes[""]}, 0

    def split(n: Node) -> None:
        nonlocal pid
        fits = [c for c in n.children if c.count <= cfg.capacity or not c.children]
        small = [c for c in fits if c.count <= cfg.capacity]
        bins = first_fit(small, cfg.capacity) + [[c] for c in fits if c.count > cfg.capacity]
        for held in bins:
            for c in held:
                c.leaf, c.pids, c.children = True, [pid], []
                kept[c.prefix] = c
            pid += 1
        for c in n.children:
            if not c.leaf:
                kept[c.prefix] = c
                split(c)
        n.pids = sorted({p for c in n.children for p in c.pids})

    split(nodes[""])
    return GlobalIndex(cfg, kept, pid)


def _from_rows(rows: list[tuple], cfg: IndexConfig) -> GlobalIndex:
    nodes = {p: Node(p, n, [], list(pids), leaf) for p, n, leaf, pids in rows}
    for p, n in sorted(nodes.items()):
        if p:
            nodes[p[: -cfg.digits]].children.append(n)
    return GlobalIndex(cfg, nodes, max((p for n in nodes.values() for p in n.pids), default=-1) + 1)


def load(table: DataFrame, cfg: IndexConfig) -> GlobalIndex:
    """The planned tree from its table (as many rows as tree nodes)."""
    rows = table.collect()
    if not rows:
        raise ValueError("the stored tree is empty")
    return _from_rows([(r.prefix, r.est_cnt, r.is_leaf, r.pids) for r in rows], cfg)


def assign(words: DataFrame, index: GlobalIndex, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``words`` (word, ...) with ``pid``: one join per leaf level, broadcast if the leaves are few enough."""
    spark, out, names = words.sparkSession, words, []
    by_level: dict[int, list[tuple[str, int]]] = {}
    for n in index.leaves():
        by_level.setdefault(len(n.prefix) // index.cfg.digits, []).append((n.prefix, n.pids[0]))
    for level, rows in sorted(by_level.items()):
        leaves = spark.createDataFrame(rows, f"_p{level} string, _pid{level} int")
        leaves = F.broadcast(leaves) if len(rows) <= broadcast_rows else leaves
        out = out.join(leaves, prefix(F.col("word"), level, index.cfg) == F.col(f"_p{level}"), "left")
        names.append(f"_pid{level}")
    return out.select(*words.columns, F.coalesce(*names, F.lit(index.overflow)).cast("int").alias("pid"))
