"""Column predicates: as filters on rows, and against a chunk's minima and maxima.

Pruning must never lose a row: a chunk goes only if its statistics prove that
no row can match.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, functions as F

from ..model import SECOND


@dataclass(frozen=True)
class Stats:
    """Least and greatest value of a column in a chunk; None if unknown."""

    low: Any = None
    high: Any = None
    has_nulls: bool = True


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Any

    def rows(self) -> Column:
        c, v = F.col(f"`{self.column}`"), F.lit(self.value)
        return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.op]

    def may_match(self, stats: dict[str, Stats]) -> bool:
        s = stats.get(self.column)
        if s is None or s.low is None or s.high is None or not comparable(self.value, s.low):
            return True
        v = self.value
        return {"=": s.low <= v <= s.high, "!=": True, "<": s.low < v, "<=": s.low <= v, ">": s.high > v, ">=": s.high >= v}[self.op]

    def columns(self) -> set[str]:
        return {self.column}


@dataclass(frozen=True)
class In:
    column: str
    values: tuple
    negated: bool = False

    def rows(self) -> Column:
        c = F.col(f"`{self.column}`").isin(*self.values) if self.values else F.lit(False)
        return ~c if self.negated else c

    def may_match(self, stats: dict[str, Stats]) -> bool:
        return self.negated or any(Compare(self.column, "=", v).may_match(stats) for v in self.values)

    def columns(self) -> set[str]:
        return {self.column}


@dataclass(frozen=True)
class Between:
    column: str
    low: Any
    high: Any

    def both(self) -> tuple[Compare, Compare]:
        return Compare(self.column, ">=", self.low), Compare(self.column, "<=", self.high)

    def rows(self) -> Column:
        return F.col(f"`{self.column}`").between(self.low, self.high)

    def may_match(self, stats: dict[str, Stats]) -> bool:
        return all(c.may_match(stats) for c in self.both())

    def columns(self) -> set[str]:
        return {self.column}


@dataclass(frozen=True)
class All:
    parts: tuple

    def rows(self) -> Column:
        return reduce(and_, [p.rows() for p in self.parts], F.lit(True))

    def may_match(self, stats: dict[str, Stats]) -> bool:
        return all(p.may_match(stats) for p in self.parts)

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts))


@dataclass(frozen=True)
class Any_:
    parts: tuple

    def rows(self) -> Column:
        return reduce(or_, [p.rows() for p in self.parts], F.lit(False))

    def may_match(self, stats: dict[str, Stats]) -> bool:
        return any(p.may_match(stats) for p in self.parts)

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts))


@dataclass(frozen=True)
class Not:
    part: Any

    def rows(self) -> Column:
        return ~self.part.rows()

    def may_match(self, stats: dict[str, Stats]) -> bool:
        return True

    def columns(self) -> set[str]:
        return self.part.columns()


def comparable(v: Any, with_: Any) -> bool:
    """Only numbers with numbers and text with text; booleans and nulls never prune."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return (number(v) and number(with_) and v == v and with_ == with_) or (isinstance(v, str) and isinstance(with_, str))


def time_range(predicate: Any, columns: tuple[str, ...] = ("timestamp_ns", "timestamp", "time")) -> tuple[int | None, int | None]:
    """The loosest closed range of times that a predicate leaves open; None where it has no bound."""
    if isinstance(predicate, Compare) and predicate.column in columns and isinstance(predicate.value, int):
        v = predicate.value
        return {"=": (v, v), "<": (None, v - 1), "<=": (None, v), ">": (v + 1, None), ">=": (v, None)}.get(predicate.op, (None, None))
    if isinstance(predicate, Between) and predicate.column in columns:
        return predicate.low, predicate.high
    if isinstance(predicate, (All, Any_)) and predicate.parts:
        lows, highs = zip(*(time_range(p, columns) for p in predicate.parts))
        if isinstance(predicate, All):
            return max((x for x in lows if x is not None), default=None), min((x for x in highs if x is not None), default=None)
        return (None if None in lows else min(lows)), (None if None in highs else max(highs))
    return None, None


def look_back(now: float, seconds: float = 3600) -> Between:
    """The last hour, for callers that want a default window; nothing applies it by itself."""
    return Between("timestamp_ns", int((now - seconds) * SECOND), int(now * SECOND))
