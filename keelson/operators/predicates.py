"""Conjunctive predicates on the columns of a projection.

Semantics are those of SQL: several bounds on one column all hold, a comparison with
NULL is never true, and a NULL in an IN list matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Param:
    """A placeholder, bound by name when a prepared scan runs."""

    name: str


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Any

    def to_column(self) -> Column:
        c, v = column(self.column), F.lit(self.value)
        return {"=": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.op]

    def bind(self, values: dict[str, Any]) -> Compare:
        return Compare(self.column, self.op, values[self.value.name]) if isinstance(self.value, Param) else self


@dataclass(frozen=True)
class In:
    column: str
    values: tuple

    def to_column(self) -> Column:
        known = [v for v in self.values if v is not None]
        if known and all(type(v) is int for v in known):
            # one call to the JVM instead of one for each value
            name = self.column.replace("`", "``")
            return F.expr(f"`{name}` IN ({', '.join(map(str, known))})")
        return column(self.column).isin(known) if known else F.lit(False)

    def bind(self, values: dict[str, Any]) -> In:
        return In(self.column, tuple(values[v.name] if isinstance(v, Param) else v for v in self.values))


@dataclass(frozen=True)
class Null:
    """IS NULL and IS NOT NULL; a projection holds no NULL."""

    column: str
    wanted: bool

    def to_column(self) -> Column:
        return column(self.column).isNull() if self.wanted else column(self.column).isNotNull()

    def bind(self, values: dict[str, Any]) -> Null:
        return self


Predicate = Compare | In | Null


def eq(column: str, value: Any) -> Compare:
    return Compare(column, "=", value)


def lt(column: str, value: Any) -> Compare:
    return Compare(column, "<", value)


def le(column: str, value: Any) -> Compare:
    return Compare(column, "<=", value)


def gt(column: str, value: Any) -> Compare:
    return Compare(column, ">", value)


def ge(column: str, value: Any) -> Compare:
    return Compare(column, ">=", value)


def between(column: str, low: Any, high: Any) -> list[Compare]:
    return [ge(column, low), le(column, high)]


def isin(column: str, *values: Any) -> In:
    return In(column, values)


def is_null(column: str) -> Null:
    return Null(column, True)


def is_not_null(column: str) -> Null:
    return Null(column, False)


def flatten(predicates) -> list[Predicate]:
    """One flat list; helpers such as ``between`` return lists."""
    out: list[Predicate] = []
    for p in predicates:
        out.extend(flatten(p) if isinstance(p, list | tuple) else [p])
    return out


def to_column(predicates: list[Predicate]) -> Column:
    return reduce(lambda a, b: a & b, [p.to_column() for p in predicates], F.lit(True))


@dataclass
class Bounds:
    """What a conjunction says about one column: a range, or that nothing matches."""

    low: Any = None
    low_open: bool = False
    high: Any = None
    high_open: bool = False
    empty: bool = False
    #: Values of the smallest IN list or equality, if any.
    points: list | None = None

    def misses(self, low: Any, high: Any) -> bool:
        """Whether no value between ``low`` and ``high`` can match."""
        if self.empty:
            return True
        if self.points is not None and not any(low <= p <= high for p in self.points):
            return True
        if self.low is not None and (high < self.low or (self.low_open and high == self.low)):
            return True
        return self.high is not None and (low > self.high or (self.high_open and low == self.high))


def bounds(predicates: list[Predicate], column: str) -> Bounds:
    """All bounds on ``column`` together: the tightest of each side."""
    out = Bounds()
    for p in predicates:
        if p.column != column:
            continue
        if isinstance(p, Null):
            out.empty |= p.wanted
        elif isinstance(p, In):
            points = [v for v in p.values if v is not None]
            out.points = points if out.points is None else [v for v in out.points if v in points]
            out.empty |= not out.points
        elif p.value is None:
            out.empty = True
        else:
            if p.op == "=":
                out.points = [p.value] if out.points is None else [v for v in out.points if v == p.value]
                out.empty |= not out.points
            if p.op in ("=", ">", ">=") and (out.low is None or (p.value, p.op == ">") > (out.low, out.low_open)):
                out.low, out.low_open = p.value, p.op == ">"
            if p.op in ("=", "<", "<=") and (out.high is None or p.value < out.high or (p.value == out.high and p.op == "<")):
                out.high, out.high_open = p.value, p.op == "<"
    if out.low is not None and out.high is not None:
        out.empty |= out.low > out.high or (out.low == out.high and (out.low_open or out.high_open))
    return out
