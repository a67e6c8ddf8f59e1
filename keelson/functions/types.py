"""Type registry: Spark type, order key and limits of every supported key type.

A type whose Spark form does not sort as wanted has an ``order_key``: an expression
that does. Values are brought into their canonical form by ``canonical``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the calendar rules for intervals: a month is 30 days, a day 24 hours.
DAYS_PER_MONTH = 30
MICROS_PER_DAY = 86_400_000_000


class TypeError_(ValueError):
    """A column's type or values cannot be held."""


def _same(c: Column) -> Column:
    return c


@dataclass(frozen=True)
class KeyType:
    """One supported type: byte width (0: variable), Spark type, canonical form and order key."""

    name: str
    width: int
    spark: T.DataType
    canonical: Callable[[Column], Column] = _same
    order_key: Callable[[Column], Column] = _same
    #: Whether it may be a key at all, and whether it may be the second one.
    key: bool = True
    second: bool = True


def _unsigned(bits: int) -> Callable[[Column], Column]:
    def check(c: Column) -> Column:
        number = c.cast("decimal(20,0)")
        bad = (number < 0) | (number > F.lit(2**bits - 1).cast("decimal(20,0)"))
        return F.when(bad, F.raise_error(F.lit(f"value out of range for an unsigned {bits}-bit type"))).otherwise(c)

    return check


def _hex_digits(c: Column, digits: int) -> Column:
    plain = F.lower(F.regexp_replace(c, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(plain) == digits, plain).otherwise(F.raise_error(F.concat(F.lit("invalid value: "), c)))


def uuid_text(c: Column) -> Column:
    """Canonical lower-case text, which sorts as the 16 bytes do."""
    h = _hex_digits(c, 32)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def mac_bytes(digits: int) -> Callable[[Column], Column]:
    return lambda c: F.unhex(_hex_digits(c, digits))


def lsn_number(c: Column) -> Column:
    """``HIGH/LOW`` in hexadecimal as one unsigned number."""
    high, low = F.split_part(c, F.lit("/"), F.lit(1)), F.split_part(c, F.lit("/"), F.lit(2))
    number = lambda x: F.conv(x, 16, 10).cast("decimal(20,0)")
    return (number(high) * F.lit(2**32).cast("decimal(20,0)") + number(low)).cast("decimal(20,0)")


def interval_micros(months: Column, days: Column, micros: Column) -> Column:
    """The order key of an interval given by its three parts."""
    return ((months * DAYS_PER_MONTH + days).cast("long") * F.lit(MICROS_PER_DAY) + micros).cast("long")


def timetz_key(c: Column) -> Column:
    """Order of a struct (utc_us, zone): the instant, then the zone."""
    return F.struct(c["utc_us"].alias("utc_us"), c["zone"].alias("zone"))


_TIMETZ = T.StructType([T.StructField("utc_us", T.LongType()), T.StructField("zone", T.IntegerType())])

REGISTRY: dict[str, KeyType] = {
    t.name: t
    for t in (
        KeyType("int2", 2, T.ShortType()),
        KeyType("int4", 4, T.IntegerType()),
        KeyType("int8", 8, T.LongType()),
        KeyType("oid", 4, T.LongType(), _unsigned(32)),
        KeyType("float4", 4, T.FloatType()),
        KeyType("float8", 8, T.DoubleType()),
        KeyType("bool", 1, T.BooleanType()),
        KeyType("date", 4, T.DateType()),
        KeyType("timestamp", 8, T.TimestampNTZType()),
        KeyType("timestamptz", 8, T.TimestampType()),
        KeyType("time", 8, T.LongType()),
        KeyType("timetz", 12, _TIMETZ, order_key=timetz_key),
        KeyType("interval", 16, T.LongType()),
        KeyType("uuid", 16, T.StringType(), uuid_text),
        KeyType("money", 8, T.DecimalType(19, 2)),
        KeyType("macaddr", 6, T.BinaryType(), mac_bytes(12)),
        KeyType("macaddr8", 8, T.BinaryType(), mac_bytes(16)),
        KeyType("name", 64, T.StringType()),
        KeyType("char", 1, T.ShortType(), _unsigned(8)),
        KeyType("pg_lsn", 8, T.DecimalType(20, 0), lsn_number),
        KeyType("text", 0, T.StringType(), second=False),
        KeyType("numeric", 0, T.DecimalType(38, 18), key=False),
    )
}

_BY_SPARK = {
    "smallint": "int2",
    "int": "int4",
    "bigint": "int8",
    "float": "float4",
    "double": "float8",
    "boolean": "bool",
    "date": "date",
    "timestamp_ntz": "timestamp",
    "timestamp": "timestamptz",
}


def type_of(data_type: T.DataType, declared: str | None = None) -> KeyType:
    """The registered type of a column, by its declared name or else by its Spark type."""
    if declared is not None:
        if declared not in REGISTRY:
            raise TypeError_(f"type {declared} is not supported")
        return REGISTRY[declared]
    name = data_type.simpleString()
    if name in _BY_SPARK:
        return REGISTRY[_BY_SPARK[name]]
    if isinstance(data_type, T.StringType):
        return REGISTRY["text"]
    if isinstance(data_type, T.DecimalType):
        return REGISTRY["numeric"]
    raise TypeError_(f"type {name} is not supported in a projection")
