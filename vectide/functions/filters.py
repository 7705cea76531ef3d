"""Temporal and metadata filters as Column predicates; all bounds are inclusive, so they reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TemporalFilter:
    """start and end in µs; None is open. A snapshot has both equal."""

    start: int | None = None
    end: int | None = None

    @classmethod
    def snapshot(cls, t: int) -> TemporalFilter:
        return cls(t, t)

    @classmethod
    def between(cls, start: int, end: int) -> TemporalFilter:
        return cls(start, end)

    @classmethod
    def before(cls, t: int) -> TemporalFilter:
        return cls(None, t)

    @classmethod
    def after(cls, t: int) -> TemporalFilter:
        return cls(t, None)

    def column(self, t: str = "t") -> Column:
        out = F.lit(True)
        if self.start is not None and self.start == self.end:
            return F.col(t) == self.start
        if self.start is not None:
            out = out & (F.col(t) >= self.start)
        if self.end is not None:
            out = out & (F.col(t) <= self.end)
        return out


ALL = TemporalFilter()


@dataclass(frozen=True)
class MetadataFilter:
    """Predicates on a map<string,string>, all of which must hold; a second predicate on a key replaces the first.

    A missing key and a value that is no number make a predicate false, never null. An empty filter holds always.
    """

    parts: tuple[tuple[str, str, object], ...] = field(default=())

    def _with(self, key: str, op: str, value: object) -> MetadataFilter:
        return MetadataFilter(tuple(p for p in self.parts if p[0] != key) + ((key, op, value),))

    def equals(self, key: str, value: str) -> MetadataFilter:
        return self._with(key, "equals", value)

    def contains(self, key: str, value: str) -> MetadataFilter:
        return self._with(key, "contains", value)

    def gte(self, key: str, value: float) -> MetadataFilter:
        return self._with(key, "gte", value)

    def lte(self, key: str, value: float) -> MetadataFilter:
        return self._with(key, "lte", value)

    def exists(self, key: str) -> MetadataFilter:
        return self._with(key, "exists", None)

    @property
    def is_empty(self) -> bool:
        return not self.parts

    def column(self, metadata: str = "metadata") -> Column:
        out = F.lit(True)
        for key, op, value in self.parts:
            m = F.try_element_at(F.col(metadata), F.lit(key))
            number = m.try_cast("double")
            test = {"equals": lambda: m == value, "contains": lambda: F.contains(m, F.lit(value)), "gte": lambda: number >= value, "lte": lambda: number <= value, "exists": lambda: F.map_contains_key(F.col(metadata), key)}[op]()
            out = out & F.coalesce(test, F.lit(False))
        return out
