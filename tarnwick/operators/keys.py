"""Key sets: the predicate language over a parameter table's whole-number keys.

A key set is a small immutable value.  It turns into a boolean column over a key column, into a
DataFrame of keys, or into another key set by intersection and splitting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeySet:
    def contains(self, key: int) -> bool:
        raise NotImplementedError

    def column(self, key: Column) -> Column:
        raise NotImplementedError

    def __iter__(self) -> Iterator[int]:
        raise TypeError("this key set can't be listed")

    def __len__(self) -> int:
        raise TypeError("this key set has no size")

    def intersect(self, other: KeySet) -> KeySet:
        raise NotImplementedError

    def dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k,) for k in self], "key long")

    def to_dict(self) -> dict:
        return {"kind": type(self).__name__} | self.__dict__


@dataclass(frozen=True)
class All(KeySet):
    """Every key; it has no size and can't be listed."""

    def contains(self, key: int) -> bool:
        return True

    def column(self, key: Column) -> Column:
        return F.lit(True)

    def intersect(self, other: KeySet) -> KeySet:
        return other


@dataclass(frozen=True)
class Empty(KeySet):
    def contains(self, key: int) -> bool:
        return False

    def column(self, key: Column) -> Column:
        return F.lit(False)

    def __iter__(self) -> Iterator[int]:
        return iter(())

    def __len__(self) -> int:
        return 0

    def intersect(self, other: KeySet) -> KeySet:
        return self


@dataclass(frozen=True)
class Range(KeySet):
    """Keys from first to last, both included; empty where last is below first."""

    first: int
    last: int

    def contains(self, key: int) -> bool:
        return self.first <= key <= self.last

    def column(self, key: Column) -> Column:
        return key.between(self.first, self.last)

    def __iter__(self) -> Iterator[int]:
        return iter(range(self.first, self.last + 1))

    def __len__(self) -> int:
        return max(0, self.last - self.first + 1)

    def dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.first, max(self.first, self.last + 1)).toDF("key")

    def intersect(self, other: KeySet) -> KeySet:
        if isinstance(other, Range):
            return self.common(other) or Empty()
        return other.intersect(self)

    def overlaps(self, other: Range) -> bool:
        return self.first <= other.last and other.first <= self.last

    def common(self, other: Range) -> Range | None:
        return Range(max(self.first, other.first), min(self.last, other.last)) if self.overlaps(other) else None

    def hull(self, other: Range) -> Range:
        return Range(min(self.first, other.first), max(self.last, other.last))

    def linear_split(self, n: int) -> list[Range]:
        """n neighbouring ranges of equal step; the last ones may be empty."""
        step = linear_step(self.first, self.last, n)
        return [Range(a := min(self.first + k * step, self.last + 1), max(a - 1, min(self.first + (k + 1) * step - 1, self.last) if k < n - 1 else self.last)) for k in range(n)]

    def hash_split(self, n: int) -> list[KeySet]:
        return [Hash.of(self.first, self.last, n, k) for k in range(n)]


@dataclass(frozen=True)
class Keys(KeySet):
    """A list of keys, without repetition and order."""

    keys: frozenset[int]

    @classmethod
    def of(cls, keys) -> Keys:
        return cls(frozenset(keys))

    def add(self, key: int) -> Keys:
        return Keys(self.keys | {key})

    def contains(self, key: int) -> bool:
        return key in self.keys

    def column(self, key: Column) -> Column:
        return key.isin(sorted(self.keys)) if self.keys else F.lit(False)

    def __iter__(self) -> Iterator[int]:
        return iter(sorted(self.keys))

    def __len__(self) -> int:
        return len(self.keys)

    def intersect(self, other: KeySet) -> KeySet:
        left = frozenset(k for k in self.keys if other.contains(k))
        return Keys(left) if left else Empty()

    def to_dict(self) -> dict:
        return {"kind": "Keys", "keys": sorted(self.keys)}


@dataclass(frozen=True)
class Hash(KeySet):
    """Keys of [low, high] that leave the remainder index when divided by modulus."""

    low: int
    high: int
    modulus: int
    index: int

    @classmethod
    def of(cls, low: int, high: int, modulus: int, index: int) -> KeySet:
        own = cls(low, high, modulus, index % modulus)
        return own if len(own) else Empty()

    @property
    def first(self) -> int:
        return self.low + (self.index - self.low) % self.modulus

    @property
    def last(self) -> int:
        return self.high - (self.high - self.index) % self.modulus

    def contains(self, key: int) -> bool:
        return self.low <= key <= self.high and key % self.modulus == self.index

    def column(self, key: Column) -> Column:
        return key.between(self.low, self.high) & (F.pmod(key, F.lit(self.modulus)) == self.index)

    def __iter__(self) -> Iterator[int]:
        return iter(range(self.first, self.last + 1, self.modulus))

    def __len__(self) -> int:
        return max(0, (self.last - self.first) // self.modulus + 1)

    def dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.first, max(self.first, self.last + 1), self.modulus).toDF("key")

    def intersect(self, other: KeySet) -> KeySet:
        if isinstance(other, Range):
            if other.first <= self.low and self.high <= other.last:
                return self
            return Hash.of(max(self.low, other.first), min(self.high, other.last), self.modulus, self.index)
        if isinstance(other, Hash):
            if other.modulus == self.modulus:
                return Hash.of(max(self.low, other.low), min(self.high, other.high), self.modulus, self.index) if other.index == self.index else Empty()
            return Keys.of(self).intersect(other)
        return other.intersect(self)


SINGLE = Range(0, 0)


def linear_step(first: int, last: int, n: int) -> int:
    return (last - first + n) // n


def linear_part(key: Column, first: int, last: int, n: int) -> Column:
    """Number of the part of a linear split into n that a key falls into."""
    return F.least(F.floor((key - first) / F.lit(linear_step(first, last, n))), F.lit(n - 1)).cast("int")


def hash_part(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n)).cast("int")


def from_dict(d: dict) -> KeySet:
    kinds = {"All": All, "Empty": Empty, "Range": Range, "Hash": Hash}
    args = {k: v for k, v in d.items() if k != "kind"}
    return Keys.of(args["keys"]) if d["kind"] == "Keys" else kinds[d["kind"]](**args)
