"""Ordered covering projections: an immutable, sorted, NULL-free copy of some columns.

A projection is a folder: ``data`` holds range-partitioned Parquet files, sorted by
the keys; ``leaves`` one row of statistics for each leaf; ``manifest.json`` the
schema, options and the key range of each file. Nothing is inserted later: a rebuild
writes a new folder, and ``is_stale`` compares the recorded source with today's.
"""

from __future__ import annotations

import json
import logging
import re
import warnings
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keelson.functions import sketches
from keelson.functions.types import KeyType, type_of
from keelson.plans.options import ProjectionOptions
from keelson.sources import storage

MAX_KEYS = 2
MAX_INCLUDES = 16
MAX_TEXT_BYTES = 32
WIDE_ROW_BYTES = 250
MANIFEST_VERSION = 2

log = logging.getLogger("keelson")


class ProjectionError(ValueError):
    """The projection cannot be built or read as asked."""


@dataclass
class FileRange:
    """One data file: its rows and the range of the leading key, where that is known."""

    name: str
    rows: int
    low: Any = None
    high: Any = None

    @property
    def ordinal(self) -> tuple[int, int, str]:
        """The place in key order: number of the task, then of its file; names alone stop sorting at 100,000 files."""
        return ordinal_of(self.name)


_NUMBERS = re.compile(r"part-(\d+).*?(?:-c(\d+)\..*)?$")


def ordinal_of(name: str) -> tuple[int, int, str]:
    found = _NUMBERS.match(name)
    return (int(found[1]), int(found[2] or 0), name) if found else (-1, 0, name)


@dataclass
class Projection:
    """An open projection."""

    spark: SparkSession
    path: str
    keys: list[str]
    include: list[str]
    where: str | None
    options: ProjectionOptions
    rows: int
    bytes: int
    types: dict[str, str]
    source: dict
    files: list[FileRange] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.include]

    def data(self, names: list[str] | None = None) -> DataFrame:
        """All rows, or those of some files; the schema is the manifest's, so no footer is read for it."""
        reader = self.spark.read.schema(", ".join(f"`{c}` {t}" for c, t in self.types.items()))
        if names is None:
            return reader.parquet(f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/data/{n}" for n in names]) if names else reader.parquet(f"{self.path}/data").limit(0)

    def leaves(self) -> DataFrame:
        """leaf, file, mn, mx, n, d, runs, combos and bloom of every leaf, in key order."""
        return self.spark.read.parquet(f"{self.path}/leaves")

    def covers(self, columns) -> bool:
        return set(columns) <= set(self.columns)

    def is_stale(self, df: DataFrame) -> bool:
        """Whether the source has other files, or files of other sizes or times, than when this was built.

        A source without files is told by its number of rows alone.
        """
        now = _fingerprint(df)
        if now["files"] or self.source["files"]:
            return now != {k: self.source[k] for k in now}
        return df.count() != self.source["rows"]

    def view(self, name: str) -> None:
        """A temporary view of the projection, for SQL over its columns."""
        self.data().createOrReplaceTempView(name)

    def key_bytes(self) -> int:
        return _width(self.types[self.keys[0]])

    def row_bytes(self) -> int:
        return sum(_width(t) for t in self.types.values())


def _width(kind: str) -> int:
    """Bytes of a value of a Spark type; text counts with its limit."""
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4}
    if kind.startswith("decimal"):
        return sketches.numeric_width(int(kind[8:].split(",")[0]))
    return fixed.get(kind, 16 if kind == "binary" else MAX_TEXT_BYTES if kind.startswith("string") else 8)


def _fingerprint(df: DataFrame) -> dict:
    """Number of the files behind ``df``, and a sum of hashes of their names, sizes and times."""
    files = [unquote(f) for f in df.inputFiles()]
    if not files:
        return {"files": 0, "hash": "0"}
    listed = df.sparkSession.read.format("binaryFile").load(files)  # lists them; contents are not read
    found = listed.select(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)").alias("h"))
    n, total = found.agg(F.count("*"), F.sum("h")).first()
    return {"files": n, "hash": str(total)}


def validate_schema(
    df: DataFrame, keys: list[str], include: list[str] = (), options: ProjectionOptions | None = None, declared: dict[str, str] | None = None
) -> dict[str, KeyType]:
    """The registered type of each column; raises if the shape is not allowed."""
    options, declared = options or ProjectionOptions(), declared or {}
    include = list(include)
    if not keys:
        raise ProjectionError("a projection needs at least one key column")
    if len(set([*keys, *include])) != len(keys) + len(include):
        raise ProjectionError("a column may be named only once")
    missing = [c for c in [*keys, *include] if c not in df.columns]
    if missing:
        raise ProjectionError(f"no such column: {', '.join(missing)}")
    found = {c: type_of(df.schema[c].dataType, declared.get(c)) for c in [*keys, *include]}
    if not options.strict:
        return found
    if len(keys) > MAX_KEYS:
        raise ProjectionError(f"at most {MAX_KEYS} key columns are supported")
    if len(include) > MAX_INCLUDES:
        raise ProjectionError(f"at most {MAX_INCLUDES} included columns are supported")
    for c in keys:
        if not found[c].key:
            raise ProjectionError(f"type {found[c].name} of column {c} cannot be a key")
    if len(keys) > 1 and not found[keys[1]].second:
        raise ProjectionError(f"column {keys[1]}: the second key must have a fixed width")
    return found


def _checks(columns: dict[str, KeyType], strict: bool) -> dict[str, Column]:
    """Aggregates that must be zero: NULLs, overlong texts, NaN."""
    out: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for i, (c, kind) in enumerate(columns.items()):
        out[f"null_{i}"] = F.count_if(F.col(f"`{c}`").isNull())
        if strict and kind.name == "text":
            out[f"long_{i}"] = F.count_if(F.octet_length(F.col(f"`{c}`")) > MAX_TEXT_BYTES)
    return out


def _read_back(observed: dict, columns: dict[str, KeyType]) -> str | None:
    """The first violation that the build saw, as a message."""
    for i, c in enumerate(columns):
        if observed[f"null_{i}"]:
            return f"column {c} has {observed[f'null_{i}']} NULL values; a projection holds none"
        if observed.get(f"long_{i}"):
            return f"text in column {c} exceeds {MAX_TEXT_BYTES} bytes ({observed[f'long_{i}']} rows)"
    return None


def build_projection(
    df: DataFrame,
    path: str,
    keys: list[str],
    include: list[str] = (),
    where: str | None = None,
    options: ProjectionOptions | None = None,
    declared: dict[str, str] | None = None,
    collation: str | None = None,
    partitions: int | None = None,
) -> Projection:
    """Sort the columns of ``df`` by ``keys`` into a new folder and describe them.

    One range exchange and one sort in each task; values are checked while they are
    written. ``where`` makes a partial projection. Without ``partitions`` Spark sizes
    the files at run time.
    """
    spark, options, include = df.sparkSession, options or ProjectionOptions(), list(include)
    kinds = validate_schema(df, keys, include, options, declared)
    if storage.exists(spark, path):
        raise ProjectionError(f"{path} exists; a projection is never changed")
    source = df
    if where is not None:
        df = df.where(where)
    canonical = {c: k.canonical(F.col(f"`{c}`")).alias(c) for c, k in kinds.items()}
    if collation:
        canonical[keys[0]] = F.collate(kinds[keys[0]].canonical(F.col(f"`{keys[0]}`")), collation).alias(keys[0])
    rows = df.select(*canonical.values())
    width = sum(_width(t) for _, t in rows.dtypes)
    if width > WIDE_ROW_BYTES:
        warnings.warn(f"rows of about {width} bytes; a narrower projection scans faster", stacklevel=2)
    order = [kinds[c].order_key(F.col(f"`{c}`")) for c in keys]
    # The payload follows the keys, in the ranges and in the sort: one hot key is spread over several files,
    # runs get longer, and files come out the same on each build.
    tail = [F.col(f"`{c}`") for c, t in rows.dtypes if c in include and not t.startswith(("array", "map"))]
    ranged = [*order, *tail]
    rows = rows.repartitionByRange(partitions, *ranged) if partitions else rows.repartitionByRange(*ranged)
    # Watched behind the exchange, as Spark reads what stands before it twice to find the ranges.
    seen = Observation()
    sorted_rows = rows.sortWithinPartitions(*ranged).observe(seen, *[c.alias(n) for n, c in _checks(kinds, options.strict).items()])
    writer = sorted_rows.write.option("parquet.block.size", options.row_group_bytes)
    if options.parquet_bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{keys[0]}", "true")
    writer.parquet(f"{path}/data")
    observed = seen.get
    if problem := _read_back(observed, kinds):
        storage.delete(spark, path)
        raise ProjectionError(problem)
    sizes = storage.file_bytes(spark, f"{path}/data")
    built = Projection(spark, path, list(keys), include, where, options, 0, sum(sizes.values()), dict(rows.dtypes), {})
    built.rows = built.data().count()
    built.source = _fingerprint(source)
    built.source["rows"] = built.rows if where is None else source.count() if not built.source["files"] else None
    _describe(built, collation)
    _save(built)
    log.debug("built %s: %d rows, %d bytes, %d files", path, built.rows, built.bytes, len(built.files))
    return built


def _describe(p: Projection, collation: str | None) -> None:
    """Leaf statistics, and from them the range of each file."""
    from keelson.operators.statistics import leaf_statistics

    if not p.options.build_zone_maps:
        return
    leaf_statistics(p, exact=False).write.parquet(f"{p.path}/leaves")
    ranges = p.leaves().groupBy("file").agg(F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
    ordered = collation is None and p.types[p.keys[0]] not in ("binary",) and not p.types[p.keys[0]].startswith("struct")
    # one row for each file, as in Spark's own file index
    for r in sorted(ranges.collect(), key=lambda r: ordinal_of(r.file)):
        p.files.append(FileRange(r.file, r.n, r.mn, r.mx) if ordered else FileRange(r.file, r.n))


_CODES: dict[type, tuple[str, Any, Any]] = {
    bool: ("b", lambda v: v, bool),
    int: ("i", lambda v: v, int),
    float: ("f", repr, float),
    str: ("s", lambda v: v, str),
    Decimal: ("d", str, Decimal),
    datetime: ("t", datetime.isoformat, datetime.fromisoformat),
    date: ("a", date.isoformat, date.fromisoformat),
}


def _coded(v: Any):
    return None if v is None else [_CODES[type(v)][0], _CODES[type(v)][1](v)]


def _decoded(v: Any):
    return None if v is None else next(d for c, _, d in _CODES.values() if c == v[0])(v[1])


def _save(p: Projection) -> None:
    held = {
        "version": MANIFEST_VERSION,
        "keys": p.keys,
        "include": p.include,
        "where": p.where,
        "options": p.options.to_dict(),
        "rows": p.rows,
        "bytes": p.bytes,
        "types": p.types,
        "source": p.source,
        "files": [[f.name, f.rows, _coded(f.low), _coded(f.high)] for f in p.files],
    }
    storage.write_text(p.spark, f"{p.path}/manifest.json", json.dumps(held))


def open_projection(spark: SparkSession, path: str) -> Projection:
    """A projection that was built before."""
    if not storage.exists(spark, f"{path}/manifest.json"):
        raise ProjectionError(f"{path} holds no projection")
    m = json.loads(storage.read_text(spark, f"{path}/manifest.json"))
    if m["version"] != MANIFEST_VERSION:
        raise ProjectionError(f"{path} has version {m['version']}, expected {MANIFEST_VERSION}")
    files = [FileRange(n, r, _decoded(lo), _decoded(hi)) for n, r, lo, hi in m["files"]]
    return Projection(
        spark, path, m["keys"], m["include"], m["where"], ProjectionOptions(**m["options"]), m["rows"], m["bytes"], m["types"], m["source"], files
    )
