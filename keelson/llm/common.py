"""Shared helpers of the training-data operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.sources import storage

#: A word, as every contract of this subpackage counts words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows and bytes that may be broadcast once they have been counted.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Rows of a range that one task runs sums over, and the number of ranges.
RANGE_ROWS = 50_000
MOST_RANGES = 4_096
#: Documents that a Python task turns into Python objects at a time.
SLICE_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again.

    The files are compressed and columnar, survive the loss of executors and are
    removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{storage.shared_folder(spark)}/keelson-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    storage.delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if name.rpartition("/")[2].startswith("keelson-"):
            storage.delete(spark, name)


def _width(name: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    column = F.col(f"`{name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
    return F.lit(8)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes, both counted, are few, else as it is."""
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    seen = df.select(width.alias("w")).limit(rows + 1).agg(F.count("w"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if seen[0] <= rows and seen[1] <= size else df


def ranges_of(rows: int) -> int:
    """Into how many ranges so many rows are cut: never more than their totals fit into one task."""
    return max(1, min(MOST_RANGES, math.ceil(rows / RANGE_ROWS)))


def ahead(df: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of that column over all rows that come before.

    The rows are cut into ranges of the order; the sums of the ranges, a bounded number,
    are all that one task sees of the whole. Rows equal in ``order`` share no order.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = ranges_of(df.count())
    parts = df.select("*", *[c.cast("long").alias(f"__{n}") for n, c in sums.items()])
    if ranges == 1:
        inside = Window.orderBy(*order)  # RANGE_ROWS rows at most
    else:
        parts = materialize(parts.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
        totals = parts.groupBy(F.col("__range").alias("__r")).agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
        upto = Window.orderBy("__r")  # one row for each range
        totals = totals.select("__r", *[(F.sum(f"__t_{n}").over(upto) - F.col(f"__t_{n}")).alias(f"__b_{n}") for n in sums])
        parts = parts.join(F.broadcast(totals), F.col("__range") == F.col("__r"))  # MOST_RANGES rows at most
        inside = Window.partitionBy("__range").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = [F.sum(f"__{n}").over(inside) - F.col(f"__{n}") + (F.col(f"__b_{n}") if ranges > 1 else F.lit(0)) for n in sums]
    return parts.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in zip(sums, found)])


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def per_document(
    df: DataFrame,
    columns: list[str],
    text: str,
    schema: str,
    make: Callable[[], Callable[[list[bytes]], dict[str, list]]],
) -> DataFrame:
    """Add columns computed by Python from whole texts, a few documents at a time.

    ``make()`` is called once in each task and returns a function from a list of
    UTF-8 texts (null texts arrive empty) to the new columns, lists or Arrow arrays,
    whose names and types ``schema`` gives. The other ``columns`` pass through as
    Arrow buffers.
    """
    passed = [df.schema[c] for c in columns]
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        work = make()
        kinds = to_arrow_schema(out)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                new = work(texts_of(part.column(part.num_columns - 1)))
                arrays = [part.column(i) for i in range(part.num_columns - 1)]
                arrays += [x if isinstance(x := new[k.name], pa.Array) else pa.array(x, type=k.type) for k in kinds]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in passed] + kinds.names)

    # By position, so that extra or clashing column names of the input do no harm.
    slim = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("__text"))
    kind = type(out)(list(passed) + list(out.fields))
    return slim.mapInArrow(run, kind)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
