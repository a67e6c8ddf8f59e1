"""Reproducible shuffle into shards by a Feistel permutation of row numbers.

Every row gets a global row number from its key and content (hash bucket, then key,
then content), never from the layout of the input. A keyed Feistel network with cycle
walking permutes ``[0, n)``; the permuted number modulo the shard count is the shard
and its quotient the slot, so counts differ by at most one, slots have no gaps, and
the place of any row can be computed without reading others.

Buckets are of key, checksum and size together, so a repeated or null key is spread
over all of them. Rows equal in all of these are interchangeable; a group of them that
would crowd its bucket is taken out, gets a run of numbers after all others, and its
rows are counted off task by task.

Defined cases: a null text has no bytes and the checksum of the empty text; a null
key is a key like any other; rows equal in key and text are interchangeable and get
different row numbers, hence different places; a text of any length is one row, shuffled
once; an empty table gives an empty table. Columns to keep travel inside a struct, so
their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import ahead, broadcast_if_small, materialize, table

SHARDS = 40
KEY = 20260131
ROUNDS = 6
#: Rows that a numbering bucket holds on average.
BUCKET_ROWS = 5_000
#: A bucket of so many times that is looked at for groups of interchangeable rows.
CROWD = 2


def _round(half: np.ndarray, key: int, turn: int, bits: int) -> np.ndarray:
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x & np.uint64(2**bits - 1)


def _once(x: np.ndarray, bits: int, key: int) -> np.ndarray:
    """One pass of the network over ``bits`` bits; the halves may differ by one bit."""
    low = bits // 2
    high = bits - low
    left, right = x >> np.uint64(low), x & np.uint64(2**low - 1)
    for turn in range(ROUNDS):
        # the halves change places, so their widths alternate
        left, right = right, left ^ _round(right, key, turn, high if turn % 2 == 0 else low)
    # after an even number of rounds the widths are as at the start
    return (left << np.uint64(low)) | right


def permute(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The permutation of ``[0, n)`` at ``numbers``: walk until back inside the range."""
    bits = max(2, (n - 1).bit_length())
    x = _once(np.asarray(numbers, np.uint64), bits, key)
    while (out := np.flatnonzero(x >= np.uint64(n))).size:
        x[out] = _once(x[out], bits, key)
    return x


_SAME = ("key", "text_crc32", "size", "hash")


def _numbered(rows: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with ``number``: those of the buckets before, then the place in the sorted bucket."""
    pages = max(1, math.isqrt(buckets))
    counts = counts.withColumn("page", F.floor(F.col("bucket") / pages))
    # Prefix sums in two levels, so that no task sees more than about sqrt(buckets) rows.
    by_page = counts.groupBy("page").agg(F.sum("count").alias("n"))
    tops = by_page.select("page", (F.sum("n").over(Window.orderBy("page")) - F.col("n")).alias("top"))
    inner = Window.partitionBy("page").orderBy("bucket")
    offsets = counts.join(tops, "page").select(
        "bucket", (F.col("top") + F.sum("count").over(inner) - F.col("count")).alias("offset")
    )
    order = Window.partitionBy("bucket").orderBy(*_SAME)
    numbered = rows.withColumn("index", F.row_number().over(order) - 1).join(broadcast_if_small(offsets), "bucket")
    return numbered.withColumn("number", F.col("offset") + F.col("index"))


def _same(groups: DataFrame) -> tuple[DataFrame, Column]:
    """``groups`` renamed, and the condition that joins rows with them."""
    renamed = groups.select(*[F.col(c).alias(f"g_{c}") for c in _SAME], *[c for c in groups.columns if c not in _SAME])
    condition = F.col("key").eqNullSafe(F.col("g_key"))
    for c in _SAME[1:]:
        condition &= F.col(c) == F.col(f"g_{c}")
    return renamed, condition


def _crowds(rows: DataFrame, counts: DataFrame) -> DataFrame | None:
    """(key, text_crc32, size, hash, n) of large groups of interchangeable rows; None if there are none."""
    crowded = counts.where(F.col("count") > CROWD * BUCKET_ROWS).select("bucket")
    if not crowded.limit(1).count():
        return None
    there = rows.join(broadcast_if_small(crowded), "bucket", "left_semi")
    groups = materialize(there.groupBy(*_SAME).agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS))
    return groups if groups.limit(1).count() else None


def _counted_off(rows: DataFrame, groups: DataFrame, first: int) -> DataFrame:
    """``number`` for the rows of ``groups``: a run for each group, from ``first`` on."""
    groups = ahead(groups, [F.col(c).asc_nulls_first() for c in _SAME], {"offset": F.col("n"), "g": F.lit(1)})
    renamed, condition = _same(groups)
    rows = rows.join(broadcast_if_small(materialize(renamed)), condition).drop(*[f"g_{c}" for c in _SAME], "n")
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    rows = materialize(rows)  # numbered by where they are written
    parts = rows.groupBy(F.col("g").alias("pg"), F.col("part").alias("pp")).count()
    upto = Window.partitionBy("pg").orderBy("pp")  # one row for each task
    parts = parts.select("pg", "pp", (F.sum("count").over(upto) - F.col("count")).alias("before"))
    rows = rows.join(broadcast_if_small(parts), (F.col("g") == F.col("pg")) & (F.col("part") == F.col("pp")))
    nth = F.row_number().over(Window.partitionBy("g", "part").orderBy("uid")) - 1
    return rows.withColumn("number", F.lit(first) + F.col("offset") + F.col("before") + nth)


def _places(rows: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """``rows`` (row, key, size, text_crc32, hash) and the columns shard and slot.

    Counts by bucket are summed on the map side; then the rows are shuffled once.
    """
    buckets = max(1, math.ceil(total / BUCKET_ROWS))
    columns = rows.columns
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*_SAME), F.lit(buckets)))
    counts = materialize(rows.groupBy("bucket").count())
    if (groups := _crowds(rows, counts)) is None:
        numbered = _numbered(rows, counts, buckets).select(*columns, "number")
    else:
        renamed, condition = _same(groups)
        others = rows.join(broadcast_if_small(renamed.drop("n")), condition, "left_anti")
        less = groups.groupBy(F.pmod(F.xxhash64(*_SAME), F.lit(buckets)).alias("b")).agg(F.sum("n").alias("gone"))
        left = counts.join(broadcast_if_small(less), F.col("bucket") == F.col("b"), "left")
        left = left.select("bucket", (F.col("count") - F.coalesce("gone", F.lit(0))).alias("count"))
        held = groups.agg(F.sum("n")).first()[0]
        numbered = _numbered(others, left, buckets).select(*columns, "number")
        numbered = numbered.unionByName(_counted_off(rows.select(*columns), groups, total - held).select(*columns, "number"))

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(np.uint64), total, seed).astype(np.int64))

    return (
        numbered.withColumn("place", place("number"))
        .withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(F.col("place") / shards).cast("long"))
    )


def _sharded(docs: DataFrame, keep: list[str], shards: int, key: str, text: str, seed: int) -> DataFrame:
    """row (a struct of ``keep``), size, text_crc32, shard and slot."""
    body = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(f"`{key}`").alias("key"),
        (F.length(body).cast("long") + 16).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("hash"),
    )
    return _places(rows, docs.count(), shards, seed)


def shard(
    docs: DataFrame,
    keep: list[str],
    shards: int = SHARDS,
    key: str = "doc_id",
    text: str = "text",
    seed: int = KEY,
) -> DataFrame:
    """The columns ``keep`` of ``docs``, then size, text_crc32, shard and slot."""
    placed = _sharded(docs, keep, shards, key, text, seed)
    return placed.select(*[F.col("row").getField(c).alias(c) for c in keep], "size", "text_crc32", "shard", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, ["doc_id"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot."""
    names = docs.columns
    placed = _sharded(docs, names, SHARDS, "doc_id", "text", KEY)
    return placed.select(*[F.col("row").getField(c).alias(c) for c in names], "shard", "slot")
