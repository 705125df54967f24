"""Hashed word shingles of many texts at once, with NumPy on the bytes of a batch.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's hash is a polynomial over its bytes modulo 2**64, taken
from one running sum for the whole batch, then mixed; a shingle's hash mixes those of its words in order. Equal shingles have
equal 64-bit hashes; different ones agree with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: Also all ASCII signs, for words without punctuation.
SIGNS = np.zeros(256, bool)
SIGNS[[*range(48), *range(58, 97), *range(123, 128)]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                _powers[i] = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, base, _U)]), dtype=_U)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def _batch(texts: list[str | None], size: int, table: np.ndarray) -> list[np.ndarray]:
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    joined = b" " + b" ".join(raw) + b" "
    b = np.frombuffer(joined, np.uint8)
    ends_of = 1 + np.cumsum([len(r) + 1 for r in raw])  # a text's end in `joined`
    blank = table[b]
    turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begin, end = turn[::2], turn[1::2]
    up, down = _power_tables(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(b.astype(_U) * up[: len(b)], dtype=_U)])
        words = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U) * _U(_STEP))
        at = np.searchsorted(begin, np.concatenate([[0], ends_of]))  # a text's words
        n = len(words) - size + 1
        rolled = np.full(max(n, 0), _U(size))
        for i in range(size):
            rolled = mix(rolled * _U(_STEP) + words[i : i + len(rolled)])
        out = []
        for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if z - a >= size:
                out.append(np.unique(rolled[a : z - size + 1]))
            elif z > a:
                h = np.full(1, _U(z - a))
                for i in range(a, z):
                    h = mix(h * _U(_STEP) + words[i : i + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, _U))
    return out


def shingle_sets(texts: list[str | None], size: int = 5, chars: int = 250_000, blanks: np.ndarray = _BLANK) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle, no words none. ``blanks`` says
    which bytes part words."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n >= chars:
            yield from _batch(held, size, blanks)
            held, n = [], 0
    if held:
        yield from _batch(held, size, blanks)
