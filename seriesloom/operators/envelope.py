"""Words that an interval query may have, and which of them to look at.

Per segment the interval's means give a range of symbols; any combination is a word that a series inside the interval may
have. There can be very many, so combinations are generated lazily and the best few by the chosen order are kept.

Orders: 0 seeded random; 1 nearest to the middle first; 2 the same backwards; 3 nearest to the word of the line midway
through the interval first; 4 the same backwards; 5 spread over the distances from the lowest combination; 6 (and any other)
evenly spaced points on the diagonal from lowest to highest. Nearness is the sum of absolute symbol differences. Ties keep
the order of the full product, in which the first segment varies slowest; for orders 1 and 2 each segment's symbols are
listed from their mean outwards (the lower of two equally far first), and the middle is the first of each list. Each order
gives as many words as were asked for, or all if there are no more (order 6: as many as the diagonal has).
"""

from __future__ import annotations

import heapq
import itertools
import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..config import IndexConfig
from ..functions.distance import segment_means, symbols_of, word_of


def symbol_ranges(lower: np.ndarray, upper: np.ndarray, cfg: IndexConfig) -> list[range]:
    lo, hi = (symbols_of(segment_means(x, cfg), cfg.cardinality) for x in (lower, upper))
    return [range(a, b + 1) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def product_size(ranges: list[range]) -> int:
    out = 1
    for r in ranges:
        out *= len(r)
    return out


def from_mean(r: range) -> list[int]:
    """Symbols from their mean outwards, the lower of two equally far first."""
    return sorted(r, key=lambda s: (abs(2 * s - r[0] - r[-1]), s))


def _by_distance(lists: list[list[int]], centre: list[int], backwards: bool) -> Iterator[tuple[int, ...]]:
    """All combinations by distance from ``centre`` and then product order of ``lists`` (or exactly backwards), by best-first
    search: only what is taken is made."""
    sign = -1 if backwards else 1
    ranks = [sorted(range(len(ls)), key=lambda i, ls=ls, c=c: (sign * abs(ls[i] - c), i)) for ls, c in zip(lists, centre, strict=True)]
    cost = [[sign * abs(ls[i] - c) for i in rs] for ls, rs, c in zip(lists, ranks, centre, strict=True)]
    start = (0,) * len(lists)
    todo = [(sum(c[0] for c in cost), start)]
    seen = {start}
    while todo:
        d, level = todo[0][0], []  # all of one distance, since equal ones must come in product order
        while todo and todo[0][0] == d:
            _, at = heapq.heappop(todo)
            level.append(tuple(rs[i] for rs, i in zip(ranks, at, strict=True)))
            for j, i in enumerate(at):
                if i + 1 < len(lists[j]):
                    new = (*at[:j], i + 1, *at[j + 1 :])
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(todo, (d - cost[j][i] + cost[j][i + 1], new))
        for own in sorted(level, reverse=backwards):
            yield tuple(ls[i] for ls, i in zip(lists, own, strict=True))


def _spread(ranges: list[range], m: int, rng: random.Random) -> list[tuple[int, ...]]:
    """m combinations (of more than m): random ones at evenly spaced distances from the lowest, then, where a distance has no
    more, at the others in turn."""
    most = sum(len(r) - 1 for r in ranges)
    ways = [[1]]  # ways[i][d]: combinations of the segments from i on with sum of steps d
    for r in reversed(ranges):
        before, new = ways[-1], [0] * (len(ways[-1]) + len(r) - 1)
        for d, n in enumerate(before):
            for s in range(len(r)):
                new[d + s] += n
        ways.append(new)
    ways.reverse()

    def numbered(d: int, number: int) -> tuple[int, ...]:
        """Combination ``number`` of those at distance d."""
        combo = []
        for i, r in enumerate(ranges):
            for s in range(len(r)):
                here = ways[i + 1][d - s] if 0 <= d - s < len(ways[i + 1]) else 0
                if number < here:
                    combo.append(r[s])
                    d -= s
                    break
                number -= here
        return tuple(combo)

    taken: dict[int, dict[int, None]] = {}
    targets = [round(i * most / max(1, m - 1)) for i in range(m)]
    for d in itertools.chain(targets, itertools.cycle(range(most + 1))):
        if sum(map(len, taken.values())) == m:
            break
        own = taken.setdefault(d, {})
        if len(own) < ways[0][d]:
            number = rng.randrange(ways[0][d])
            while number in own:
                number = (number + 1) % ways[0][d]
            own[number] = None
    return [numbered(d, number) for d in sorted(taken) for number in taken[d]]


def _diagonal(ranges: list[range], m: int) -> list[tuple[int, ...]]:
    """One word: each segment's lower middle. More: m steps from lowest to highest, rounded half up up to the last whole one
    below the highest, from there the highest."""
    out: list[tuple[int, ...]] = []
    for i in range(m):
        combo = []
        for r in ranges:
            low, wide = r[0], len(r) - 1
            if m == 1:
                combo.append(low + wide // 2)
            elif i * wide <= (wide - 1) * (m - 1) and i < m - 1:
                combo.append(low + (2 * i * wide + m - 1) // (2 * (m - 1)))
            else:
                combo.append(r[-1])
        if tuple(combo) not in out:
            out.append(tuple(combo))
    return out


def combinations(lower: np.ndarray, upper: np.ndarray, cfg: IndexConfig, m: int, order: int, seed: int = 42) -> list[tuple[int, ...]]:
    """At most m combinations of symbols; all of them, in product order, if there are no more (orders 0, 5 and 6)."""
    ranges = symbol_ranges(lower, upper, cfg)
    size = product_size(ranges)
    if order in (1, 2):
        lists = [from_mean(r) for r in ranges]
        return list(itertools.islice(_by_distance(lists, [ls[0] for ls in lists], order == 2), m))
    if order in (3, 4):
        centre = symbols_of(segment_means((lower + upper) / 2, cfg), cfg.cardinality).tolist()
        return list(itertools.islice(_by_distance([list(r) for r in ranges], centre, order == 4), m))
    if size <= m:
        return list(itertools.product(*ranges))
    rng = random.Random(seed)
    if order == 0:
        picked: dict[tuple[int, ...], None] = {}
        while len(picked) < m:
            picked[tuple(rng.choice(r) for r in ranges)] = None
        return list(picked)
    return _spread(ranges, m, rng) if order == 5 else _diagonal(ranges, m)


def words_of(lower: np.ndarray, upper: np.ndarray, cfg: IndexConfig, m: int, order: int, seed: int = 42) -> list[str]:
    return [word_of(c, cfg) for c in combinations(lower, upper, cfg, m, order, seed)]


def register_udtf(spark: SparkSession, cfg: IndexConfig, name: str = "interval_words") -> None:
    """SQL: ``interval_words(lower, upper, most, word_order)`` gives a row (position, word) each, for lateral joins."""
    from pyspark.sql.functions import udtf

    class IntervalWords:
        def eval(self, lower, upper, most, word_order):
            for i, w in enumerate(words_of(np.array(lower, float), np.array(upper, float), cfg, most, word_order)):
                yield i, w

    spark.udtf.register(name, udtf(IntervalWords, returnType="position int, word string"))


def word_rows(spark: SparkSession, intervals: DataFrame, cfg: IndexConfig, m: int, order: int) -> DataFrame:
    """(qid, position, word) of interval queries (qid, lower, upper)."""
    register_udtf(spark, cfg)
    intervals.createOrReplaceTempView("_intervals")
    return spark.sql(f"select q.qid, w.position, w.word from _intervals q, lateral interval_words(q.lower, q.upper, {int(m)}, {int(order)}) w")
