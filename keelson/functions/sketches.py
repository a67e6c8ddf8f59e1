"""Column expressions: 64-bit Bloom filters, run-length decisions and scaled decimals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTINCT_LIMIT = 65_535


def bloom_bits(key: Column, nhash: int = 2) -> Column:
    """The bits of a key in a 64-bit filter, as a long."""
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(first, 1) + F.shiftright(second, 4) * i, F.lit(64)).cast("int")) for i in range(nhash)]
    return reduce(lambda a, b: a.bitwiseOR(b), bit)


def bloom(key: Column, nhash: int = 2) -> Column:
    """Aggregate: the filter of all keys of a group."""
    return F.bit_or(bloom_bits(key, nhash))


def might_contain(bloom_filter: Column, key: Column, nhash: int = 2) -> Column:
    """False only if the key is not in the filter; an absent filter may contain anything."""
    bits = bloom_bits(key, nhash)
    return bloom_filter.isNull() | (bloom_filter.bitwiseAND(bits) == bits)


def saturated(count: Column) -> Column:
    return F.least(count, F.lit(DISTINCT_LIMIT).cast("long"))


def run_bytes(runs: Column, width: int) -> Column:
    """Bytes of a run-length coded leaf: a value and a count for each run."""
    return runs * (width + 2) + 8


def plain_bytes(rows: Column, width: int) -> Column:
    return rows * width + 4


def is_run_coded(runs: Column, rows: Column, width: int, threshold: float = 0.98) -> Column:
    """Whether runs are worth coding: smaller than plain, and few enough."""
    return (run_bytes(runs, width) < plain_bytes(rows, width)) & (runs / rows < threshold)


def numeric_width(precision: int) -> int:
    """Bytes of a scaled integer of so many digits."""
    if not 1 <= precision <= 38:
        raise ValueError(f"numeric precision {precision} must be between 1 and 38")
    return next(w for p, w in ((4, 2), (9, 4), (18, 8), (38, 16)) if precision <= p)


def to_scaled_int(value: Column, scale: int) -> Column:
    """The value times 10^scale as a long, halves rounded away from zero."""
    return (F.round(value, scale) * F.lit(10**scale)).cast("long")


def from_scaled_int(scaled: Column, precision: int, scale: int) -> Column:
    return (scaled.cast("decimal(38,0)") / F.lit(10**scale)).cast(f"decimal({precision},{scale})")


def unbounded_numeric(value: Column) -> Column:
    """A decimal without declared precision is held as decimal(18,4)."""
    return value.cast("decimal(18,4)")
