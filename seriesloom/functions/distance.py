"""Distances and lower bounds: as column expressions, and as NumPy kernels for searches.

A node's word of L levels stands for a box: per segment the bin of its symbol at cardinality 2**L. The bound from a query to
the box weighs each segment's squared gap by the points of that segment, so it holds for uneven last segments too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import IndexConfig
from .breakpoints import breakpoints
from .representation import total, word_symbols


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def interval_euclidean(v: Column, lower: Column, upper: Column) -> Column:
    """Distance of a series to an interval series: per point how far it lies outside."""
    gaps = F.zip_with(v, F.arrays_zip(lower.alias("l"), upper.alias("u")), lambda x, i: F.greatest(i["l"] - x, x - i["u"], F.lit(0.0)))
    return F.sqrt(total(F.transform(gaps, lambda g: g * g)))


def node_bound(w: Column, lower: Column, upper: Column, cfg: IndexConfig) -> Column:
    """Lower bound from segment means (lower = upper for a scalar query) to the node of word ``w``; 0 for the root."""
    inf = float("inf")

    def at(level: int) -> Column:
        bounds = F.array(F.lit(-inf), *(F.lit(b) for b in breakpoints(1 << level)), F.lit(inf))
        syms = word_symbols(w, cfg)
        boxes = F.transform(syms, lambda s: F.struct(F.element_at(bounds, s + 1).alias("lo"), F.element_at(bounds, s + 2).alias("hi")))
        gaps = F.zip_with(boxes, F.arrays_zip(lower.alias("l"), upper.alias("u")), lambda b, q: F.greatest(b["lo"] - q["u"], q["l"] - b["hi"], F.lit(0.0)))
        return F.sqrt(total(F.transform(gaps, lambda g, i: g * g * F.least(F.lit(cfg.step), F.lit(cfg.length) - i * cfg.step))))

    out = F.when(F.length(w) == 0, F.lit(0.0))
    for level in range(1, cfg.bits + 1):
        out = out.when(F.length(w) == level * cfg.digits, at(level))
    return out


def symbol_bound(a: Column, b: Column, cardinality: int) -> Column:
    """Lower bound between two arrays of symbols, in units of segment means; symbols that touch are at distance 0."""
    bounds = F.array(*(F.lit(x) for x in breakpoints(cardinality)))
    gap = F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) <= 1, F.lit(0.0)).otherwise(F.element_at(bounds, F.greatest(x, y)) - F.element_at(bounds, F.least(x, y) + 1)))
    return F.sqrt(total(F.transform(gap, lambda g: g * g)))


# NumPy twins, for the driver's planning and for kernels inside tasks


def segment_means(values: np.ndarray, cfg: IndexConfig) -> np.ndarray:
    starts = np.arange(0, cfg.length, cfg.step)
    return np.add.reduceat(values, starts, axis=-1) / np.diff(np.append(starts, cfg.length))


def symbols_of(means: np.ndarray, cardinality: int) -> np.ndarray:
    return np.searchsorted(np.array(breakpoints(cardinality)), means, side="right")


def word_of(syms, cfg: IndexConfig) -> str:
    return "".join(f"{sum((int(s) >> i & 1) << (len(syms) - 1 - j) for j, s in enumerate(syms)):0{cfg.digits}x}" for i in range(cfg.bits - 1, -1, -1))


def unword(w: str, cfg: IndexConfig) -> np.ndarray:
    levels = [int(w[i : i + cfg.digits], 16) for i in range(0, len(w), cfg.digits)]
    out = np.zeros(cfg.word_length, int)
    for x in levels:
        out = out * 2 + np.array([x >> (cfg.word_length - 1 - j) & 1 for j in range(cfg.word_length)])
    return out


def boxes(words: list[str], cfg: IndexConfig) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper edges (words, segments) of the nodes' boxes; the root's are infinite."""
    lo, hi = np.full((len(words), cfg.word_length), -np.inf), np.full((len(words), cfg.word_length), np.inf)
    shifts = np.arange(cfg.word_length - 1, -1, -1)
    lengths = np.array([len(w) for w in words], int)
    for size in np.unique(lengths[lengths > 0]) if len(words) else []:
        at, level = np.flatnonzero(lengths == size), int(size) // cfg.digits
        digits = np.array([[int(words[i][k : k + cfg.digits], 16) for k in range(0, size, cfg.digits)] for i in at], object if cfg.word_length > 62 else np.int64)
        syms = np.zeros((len(at), cfg.word_length), int)
        for x in digits.T:
            syms = syms * 2 + ((x[:, None] >> shifts) & 1)
        edges = np.concatenate([[-np.inf], breakpoints(1 << level), [np.inf]])
        lo[at], hi[at] = edges[syms], edges[syms + 1]
    return lo, hi


def bounds_to(lo: np.ndarray, hi: np.ndarray, lower: np.ndarray, upper: np.ndarray, cfg: IndexConfig) -> np.ndarray:
    """Bounds of one query's segment means to boxes."""
    weight = np.diff(np.append(np.arange(0, cfg.length, cfg.step), cfg.length))
    gap = np.maximum(0, np.maximum(lo - upper, lower - hi))
    return np.sqrt((gap * gap) @ weight)


def box_bounds(words: list[str], lower: np.ndarray, upper: np.ndarray, cfg: IndexConfig) -> np.ndarray:
    """Bounds of one query to each node."""
    return bounds_to(*boxes(words, cfg), lower, upper, cfg)


def distances(values: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Distances of series (rows) to one query, an interval or (lower is upper) a series."""
    if lower is upper:
        gap = values - lower
    else:
        gap = np.maximum(0, np.maximum(lower - values, values - upper))
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))
