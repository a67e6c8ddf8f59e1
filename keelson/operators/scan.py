"""Scans over a projection: conjunctions of bounds, either direction, limits, cursors.

A scan is a lazy DataFrame over the projection alone. Files whose key range cannot
match are left out by the manifest before Spark plans anything; inside the rest, the
Parquet reader skips row groups and pages by their own ranges. An ordered scan with a
limit reads only as many files from its end of the key order as can hold the answer.
Files are sorted by their ranges, so those that match are found by bisection.
"""

from __future__ import annotations

import logging
from bisect import bisect_left, bisect_right
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import predicates as P
from keelson.sources.projection import FileRange, Projection


log = logging.getLogger("keelson")


class NotCovered(ValueError):
    """The projection lacks a column; only the base table can answer."""


def _comparable(low: Any, value: Any) -> bool:
    """Whether Python orders the two as Spark does."""
    if isinstance(value, float) and value != value:
        return False
    if isinstance(low, bool) or isinstance(value, bool):
        return isinstance(low, bool) and isinstance(value, bool)
    if isinstance(low, int | float) and isinstance(value, int | float):
        return low == low
    if isinstance(low, datetime) != isinstance(value, datetime):
        return False
    if isinstance(low, datetime):
        return low.tzinfo is None and value.tzinfo is None
    return type(low) is type(value) and isinstance(low, str | date)


def _bytewise(v: Any) -> Any:
    return v.encode() if isinstance(v, str) else v


class Edges:
    """The lowest and highest keys of the files of a projection, in key order, where they are known to be sorted."""

    def __init__(self, files: list[FileRange]):
        self.files = sorted(files, key=lambda f: f.ordinal)
        self.lows = [_bytewise(f.low) for f in self.files]
        self.highs = [_bytewise(f.high) for f in self.files]
        pairs = [self.lows, self.highs]
        # a float range that ends in NaN has no order here
        self.sorted = all(x == x for e in pairs for x in e) and all(x <= y for e in pairs for x, y in zip(e, e[1:]))

    def matching(self, limits: P.Bounds) -> list[FileRange]:
        if not self.sorted:
            return [f for f, lo, hi in zip(self.files, self.lows, self.highs) if hi != hi or lo != lo or not limits.misses(lo, hi)]
        if limits.empty:
            return []
        first, end = 0, len(self.files)
        if limits.low is not None:
            first = (bisect_right if limits.low_open else bisect_left)(self.highs, limits.low)
        if limits.high is not None:
            end = (bisect_left if limits.high_open else bisect_right)(self.lows, limits.high)
        if limits.points is None:
            return self.files[first:end]
        hit = {i for p in limits.points for i in range(max(first, bisect_left(self.highs, p)), min(end, bisect_right(self.lows, p)))}
        return [self.files[i] for i in sorted(hit)]


def _edges(p: Projection) -> Edges:
    """Worked out once for each list of files."""
    known = p.__dict__.get("_edges")
    if known is None or known[0] is not p.files or known[1] != len(p.files):
        known = p.__dict__["_edges"] = (p.files, len(p.files), Edges(p.files))
    return known[2]


def _limits(p: Projection, preds: list[P.Predicate]) -> P.Bounds | None:
    """The bounds of the leading key; None where Python cannot order the values as Spark does."""
    own = [q for q in preds if q.column == p.keys[0]]
    values = [v for q in own if isinstance(q, P.In) for v in q.values if v is not None]
    values += [q.value for q in own if isinstance(q, P.Compare) and q.value is not None]
    if not all(_comparable(p.files[0].low, v) for v in values):
        return None
    bytewise = [q if isinstance(q, P.Null) else P.In(q.column, tuple(map(_bytewise, q.values))) if isinstance(q, P.In) else P.Compare(q.column, q.op, _bytewise(q.value)) for q in own]
    return P.bounds(bytewise, p.keys[0])


def files_for(p: Projection, preds: list[P.Predicate]) -> list[FileRange] | None:
    """Files whose range of the leading key can match, in key order; None where that is unknown."""
    if not p.options.zone_maps or not p.files or any(f.low is None for f in p.files):
        return None
    limits = _limits(p, preds)
    return None if limits is None else _edges(p).matching(limits)


def _inside(f: FileRange, limits: P.Bounds) -> bool:
    """Whether every row of a file passes; only ranges can tell."""
    low, high = _bytewise(f.low), _bytewise(f.high)
    if limits.points is not None:
        return low == high and low in limits.points
    above = limits.low is None or low > limits.low or (low == limits.low and not limits.low_open)
    return above and (limits.high is None or high < limits.high or (high == limits.high and not limits.high_open))


def _ends(files: list[FileRange], wanted: int, descending: bool, limits: P.Bounds | None = None) -> list[FileRange]:
    """The first files in scan order that hold the first ``wanted`` rows in any case.

    With ``limits``, only files that lie wholly inside count with their rows. A key may go
    on in the next file, so files that share the last one's outer key are taken too.
    """
    out, rows = [], 0
    for f in sorted(files, key=lambda f: f.ordinal, reverse=descending):
        edge = out and (out[-1].low == f.high if descending else out[-1].high == f.low)
        if out and rows >= wanted and not edge:
            break
        out.append(f)
        rows += f.rows if limits is None or _inside(f, limits) else 0
    return out


def scan(
    p: Projection,
    *preds: P.Predicate | list,
    columns: list[str] | None = None,
    order: str | None = None,
    then: list[str] = (),
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Rows of ``p`` that satisfy all predicates.

    ``order`` is "asc" or "desc" by the keys, then by the columns ``then`` in the same
    direction; with a limit these should make the order total.
    """
    wanted = columns if columns is not None else p.columns
    flat = P.flatten(preds)
    needed = {*wanted, *then, *(q.column for q in flat)}
    if not p.covers(needed):
        raise NotCovered(f"not in the projection: {', '.join(sorted(needed - set(p.columns)))}; it answers covered queries only")
    files = files_for(p, flat)
    if files is not None and order and limit is not None and all(q.column == p.keys[0] for q in flat):
        files = _ends(files, limit + offset, order == "desc", _limits(p, flat) if flat else None)
    if files is not None:
        log.debug("scan of %s: %d of %d files", p.path, len(files), len(p.files))
    whole = files is None or len(files) == len(p.files)
    df = p.data(None if whole else [f.name for f in files])
    if flat:
        df = df.where(P.to_column(flat))
    if order:
        direction = F.desc if order == "desc" else F.asc
        df = df.orderBy(*[direction(P.column(c)) for c in [*p.keys, *then]])
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*map(P.column, wanted))


class PreparedScan:
    """A scan with named parameters, bound anew on each run."""

    def __init__(self, p: Projection, *preds: P.Predicate | list, **how: Any):
        self.p, self.preds, self.how = p, P.flatten(preds), how

    def run(self, **values: Any) -> DataFrame:
        return scan(self.p, *[q.bind(values) for q in self.preds], **self.how)


class Cursor:
    """A scrollable position in an ordered scan; the order must be total."""

    def __init__(self, p: Projection, *preds: P.Predicate | list, **how: Any):
        self.p, self.preds, self.how, self.at = p, preds, {"order": "asc"} | how, 0

    def forward(self, n: int) -> list:
        rows = scan(self.p, *self.preds, limit=n, offset=self.at, **self.how).collect()
        self.at += len(rows) if len(rows) == n else len(rows) + 1
        return rows

    def backward(self, n: int) -> list:
        """The rows before the position, nearest first."""
        first = max(0, self.at - 1 - n)
        count = max(0, self.at - 1 - first)
        rows = scan(self.p, *self.preds, limit=count, offset=first, **self.how).collect() if count else []
        self.at = max(0, self.at - n)
        return rows[::-1]

    def move(self, n: int) -> None:
        self.at = max(0, self.at + n)


def lookup_join(outer: DataFrame, p: Projection, on: dict[str, str], columns: list[str], *preds: P.Predicate | list) -> DataFrame:
    """Inner join of ``outer`` with a scan of ``p``: for each outer row, its matches by key.

    ``on`` maps a column of ``outer`` to one of ``p``. Spark chooses the join; the scan
    reads the wanted columns only.
    """
    inner = scan(p, *preds, columns=sorted({*columns, *on.values()}))
    renamed = inner.select(*[F.col(c).alias(f"__{c}") for c in inner.columns])
    condition = [outer[a] == renamed[f"__{b}"] for a, b in on.items()]
    joined = outer.join(renamed, condition)
    return joined.select(*outer.columns, *[F.col(f"__{c}").alias(c) for c in columns if c not in outer.columns])
