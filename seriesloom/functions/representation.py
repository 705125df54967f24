"""Series as column expressions: normalisation, segment means, symbols and hierarchical words.

A series is an array of numbers without null or NaN (see :func:`valid`). All arithmetic is in doubles. A word is a hex string,
level by level: level L holds bit L (from the highest) of every symbol, so the first L levels are the word of the
alphabet with 2**L symbols and a tree of words is walked by string prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import IndexConfig
from .breakpoints import breakpoints


def valid(v: Column, length: int) -> Column:
    """Whether an array is a series of this length: no null, NaN or infinity."""
    return v.isNotNull() & (F.size(v) == length) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def running_sum(v: Column) -> Column:
    """Sum of the points up to each."""
    empty = F.array().cast("array<double>")
    return F.aggregate(v, F.struct(F.lit(0.0).alias("s"), empty.alias("out")), lambda a, x: F.struct((a.s + x).alias("s"), F.concat(a.out, F.array(a.s + x)).alias("out")), lambda a: a.out)


def z_normalise(v: Column) -> Column:
    """Zero mean, unit sample deviation; null for a constant series, which has none."""

    def scaled(v: Column) -> Column:
        mean = F.try_divide(total(v), F.size(v))

        def by(m: Column) -> Column:
            deviation = F.sqrt(F.try_divide(total(F.transform(v, lambda x: (x - m) * (x - m))), F.size(v) - 1))
            return F.transform(F.array(deviation), lambda s: F.when(s > 0, F.transform(v, lambda x: (x - m) / s)))[0]

        return F.transform(F.array(mean), by)[0]  # a lambda's argument is computed once

    return F.transform(F.array(doubles(v)), scaled)[0]


def paa(v: Column, cfg: IndexConfig) -> Column:
    """Means of the segments, each over its own number of points."""
    return F.transform(F.sequence(F.lit(0), F.lit(cfg.word_length - 1)), lambda i: total(F.slice(v, i * cfg.step + 1, F.lit(cfg.step))) / F.least(F.lit(cfg.step), F.lit(cfg.length) - i * cfg.step))


def paa_interval(lower: Column, upper: Column, cfg: IndexConfig) -> Column:
    """(lower means, upper means) of an interval series."""
    return F.struct(paa(lower, cfg).alias("lower"), paa(upper, cfg).alias("upper"))


def paa_middle(lower: Column, upper: Column, cfg: IndexConfig) -> Column:
    """Segment means of the line midway through the interval."""
    return paa(F.zip_with(lower, upper, lambda a, b: (a + b) / 2), cfg)


def symbols(means: Column, cardinality: int) -> Column:
    """Bin of each mean: the number of breakpoints at or below it (a mean on a breakpoint goes to the upper bin)."""
    bounds = F.array(*(F.lit(b) for b in breakpoints(cardinality)))
    return F.transform(means, lambda m: F.size(F.filter(bounds, lambda b: b <= m)))


def word(syms: Column, bits: int, digits: int) -> Column:
    """Level-major hex word of an array of symbols."""

    def spelt(i: int) -> Column:
        value = F.aggregate(syms, F.lit(0).cast("long"), lambda a, s: a * 2 + F.shiftright(s, i).bitwiseAND(F.lit(1)))
        return F.lpad(F.lower(F.hex(value)), digits, "0")

    return F.concat(*(spelt(i) for i in range(bits - 1, -1, -1)))


def series_word(v: Column, cfg: IndexConfig) -> Column:
    """The word of a series."""
    return F.transform(F.array(symbols(paa(v, cfg), cfg.cardinality)), lambda s: word(s, cfg.bits, cfg.digits))[0]


def prefix(w: Column, level: int | Column, cfg: IndexConfig) -> Column:
    """A word's first levels."""
    return F.substring(w, 1, level * cfg.digits) if isinstance(level, int) else F.substring(w, F.lit(1), level * cfg.digits)


def parent(w: Column, cfg: IndexConfig) -> Column:
    """A word without its last level."""
    return F.substring(w, F.lit(1), F.length(w) - cfg.digits)


def level_of(w: Column, cfg: IndexConfig) -> Column:
    return (F.length(w) / cfg.digits).cast("int")


def under(w: Column, node: Column) -> Column:
    """Whether a word lies under a node."""
    return F.startswith(w, node)


def in_nodes(w: Column, nodes: list[str]) -> Column:
    """Whether a word lies under one of some nodes."""
    if not nodes:
        return F.lit(False)
    lengths = sorted({len(x) for x in nodes})
    return F.greatest(F.lit(False), *(F.substring(w, 1, n).isin([x for x in nodes if len(x) == n]) for n in lengths))


def word_symbols(w: Column, cfg: IndexConfig) -> Column:
    """Symbols of a word (of any number of levels), for any number of segments."""
    n, d = cfg.word_length, cfg.digits
    levels = F.transform(F.sequence(F.lit(0), (F.length(w) / d).cast("int") - 1), lambda i: F.conv(F.substring(w, (i * d + 1).cast("int"), F.lit(d)), 16, 10).cast("long"))

    def symbol(j: int) -> Column:
        return F.aggregate(levels, F.lit(0), lambda a, x: (a * 2 + F.shiftright(x, n - 1 - j).bitwiseAND(F.lit(1)).cast("int")).cast("int"))

    return F.when(F.length(w) > 0, F.array(*(symbol(j) for j in range(n)))).otherwise(F.array_repeat(F.lit(0), n))


def bloom_key(w: Column, v: Column, features: bool) -> Column:
    """What a Bloom filter holds of a record: its word, with its largest and smallest value if asked for."""
    return F.concat_ws("|", w, F.array_max(v).cast("string"), F.array_min(v).cast("string")) if features else w
