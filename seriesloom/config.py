"""Settings: frozen, validated, with the values derived from them; and a reader for ``key=value`` files."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace
from pathlib import Path

#: The alphabet sizes for which breakpoints are defined.
CARDINALITIES = (*range(2, 21), 32, 64, 128, 256)


@dataclass(frozen=True)
class IndexConfig:
    """How series become words, partitions and local nodes.

    ``length`` points are averaged in segments of ``step`` points (the last may be shorter), each segment becomes a symbol
    of ``bits`` bits, and level L of a word is the symbols' L highest bits. Indexed search needs a power-of-two
    ``cardinality``, for which levels nest; other sizes serve the plain symbol functions.
    """

    length: int = 256
    segments: int = 8
    cardinality: int = 64
    block_mb: float = 128.0
    occupancy: float = 0.95
    max_records: int | None = None  # capacity of a partition; from the block size if not given
    leaf_threshold: int = 1000
    sample_fraction: float = 0.1
    sampling: bool = True
    block_sampling: bool = True
    bloom: bool = False
    bloom_rate: float = 0.1
    bloom_features: bool = False
    seed: int = 42

    def __post_init__(self):
        if self.length < 1 or not 1 <= self.segments <= self.length:
            raise ValueError("need 1 <= segments <= length")
        if self.cardinality not in CARDINALITIES:
            raise ValueError(f"cardinality {self.cardinality} has no breakpoints")
        if not 0 < self.sample_fraction <= 1 or self.word_length > 62:
            raise ValueError("sample_fraction must be in (0, 1] and a word at most 62 segments long")

    @property
    def step(self) -> int:
        return self.length // self.segments + (self.length % self.segments > 0)

    @property
    def word_length(self) -> int:
        """Segments that really come out; fewer than asked for if steps don't divide the length."""
        return -(-self.length // self.step)

    @property
    def bits(self) -> int:
        """Bits of a symbol, and levels of a word."""
        return math.ceil(math.log2(self.cardinality))

    @property
    def digits(self) -> int:
        """Hex digits of a level."""
        return -(-self.word_length // 4)

    @property
    def capacity(self) -> int:
        """Most records of a partition, so that it fits a block."""
        if self.max_records is not None:
            return self.max_records
        record = (4 * self.length + 8 + (self.word_length // 4) * 2 * self.bits) * 1.08
        return int(self.occupancy * self.block_mb * 1024 * 1024 / record)

    @property
    def fraction(self) -> float:
        return self.sample_fraction if self.sampling else 1.0

    def index_path(self, series_path: str) -> str:
        flags = f"{self.fraction:g}-{self.word_length}-{'bf-' * self.bloom}{self.leaf_threshold}-{'blocks' if self.block_sampling else 'records'}"
        return f"{series_path.rstrip('/')}-{flags}-index"

    def bloom_path(self, series_path: str) -> str:
        return self.index_path(series_path).removesuffix("-index") + ("-bloom-features" if self.bloom_features else "-bloom")

    def require_indexable(self) -> None:
        if self.cardinality & (self.cardinality - 1):
            raise ValueError("an index needs a power-of-two cardinality")


@dataclass(frozen=True)
class WalkConfig:
    """Random walks, and the bands of interval queries."""

    count: int = 1000
    length: int = 256
    seed: int = 42
    block_mb: float = 128.0
    bands: bool = False
    band_share: float = 0.1
    band_segments: int = 1
    band_height: float = 1.0
    segments: int = 8
    cardinality: int = 64

    def partitions(self, rate: float = 1.05) -> int:
        """Output partitions of about a block each."""
        record = self.length * 4 * (2 if self.bands else 1) + 8
        return max(1, math.ceil(self.count * record * rate / 1024 / 1024 / self.block_mb))

    def path(self, root: str) -> str:
        return f"{root.rstrip('/')}/walks-{self.count}-{self.length}-{self.partitions()}"


@dataclass(frozen=True)
class QueryConfig:
    k: int = 500
    knn_type: int = 0  # 0 target node, 1 home partition, 2 sibling partitions
    radius: float = 7.5
    max_words: int = 3
    word_order: int = 0  # 0 to 6, see operators.envelope
    min_partitions: int = 1
    max_partitions: int | None = None  # of kind 2, besides the home; all if not given
    bloom: bool = False
    seed: int = 42


@dataclass(frozen=True)
class LabelConfig:
    count: int = 100
    include: float = 0.5
    k: int = 500
    radius: float = 7.5
    most: int = 300_000
    seed: int = 42

    def path(self, series_path: str, kind: str) -> str:
        return f"{series_path.rstrip('/')}-label-{kind}-{self.count}"


def truth(text: str) -> bool:
    """``true`` and ``yes`` are true, all else is false."""
    return text.strip().lower() in ("true", "yes")


def read_properties(path: str | Path) -> dict[str, str]:
    """``key=value`` lines; a line with ``#`` anywhere is a comment."""
    out = {}
    for line in Path(path).read_text().splitlines():
        if "#" not in line and "=" in line:
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip()
    return out


def from_properties(kind: type, values: dict[str, str]):
    """A settings object from those of ``values`` that it knows."""
    picked = {}
    for f in fields(kind):
        if f.name in values:
            default = getattr(kind(), f.name)
            picked[f.name] = truth(values[f.name]) if isinstance(default, bool) else (type(default) if default is not None else int)(values[f.name])
    return replace(kind(), **picked)


def describe(config) -> str:
    """Settings and derived values, a line each."""
    derived = [n for n in ("step", "word_length", "bits", "digits", "capacity") if hasattr(config, n)]
    return "\n".join(f"{n} = {getattr(config, n)}" for n in [*(f.name for f in fields(config)), *derived])


__all__ = ["CARDINALITIES", "IndexConfig", "LabelConfig", "QueryConfig", "WalkConfig", "describe", "from_properties", "read_properties", "truth"]
