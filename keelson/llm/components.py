"""Connected components of a link table, wholly distributed.

Alternating large-star and small-star steps: every step replaces a node's links by
links to the smallest node it knows of, until nothing changes. A node's neighbours
are never gathered into one task: the smallest is found by a partial aggregate and
given back by a join whose heavy side Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    # every larger neighbour is linked to the smallest node around
    moved = both.join(least, F.col("a") == F.col("k")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from larger to smaller nodes."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    joined = links.join(least, F.col("a") == F.col("k"))
    moved = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("k", "m")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots themselves.

    The root is the smallest node of the component. An empty table gives an empty one.
    """
    links = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _state(links)
    while before[0]:
        old, links = links, materialize(_small_star(_large_star(links)))
        discard(old)
        now = _state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
