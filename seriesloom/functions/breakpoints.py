"""Breakpoints that cut the standard normal distribution into equally likely bins."""

from __future__ import annotations

from functools import cache
from statistics import NormalDist

from ..config import CARDINALITIES

#: Alphabet sizes whose breakpoints are rounded to five significant digits; the others to two decimals.
_FINE = (2, 3, 4, 8, 16, 32, 64, 128, 256)


@cache
def breakpoints(cardinality: int) -> tuple[float, ...]:
    """The ``cardinality - 1`` inner bounds. Those of a power of two are among those of the next (levels nest)."""
    if cardinality not in CARDINALITIES:
        raise ValueError(f"cardinality {cardinality} has no breakpoints")
    out = (NormalDist().inv_cdf(i / cardinality) for i in range(1, cardinality))
    return tuple((float(f"{x:.5g}") if cardinality in _FINE else round(x, 2)) + 0.0 for x in out)
