"""Leaf statistics, upper levels, pruning, inspection and profiles of a projection.

A leaf is a run of rows of one data file, ``leaf_rows`` long. Its number within the
file comes from the reader's row index, so no row is sorted or shipped to find it; the
global number adds the leaves of the files before, a sum over files only.
"""

from __future__ import annotations

import re
import time
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import sketches
from keelson.operators import predicates as P
from keelson.sources.projection import Projection

#: Files up to which their list is broadcast.
BROADCAST_FILES = 500_000
#: Relative error of estimated distinct counts.
DISTINCT_ERROR = 0.02


def leaf_statistics(p: Projection, leaf_rows: int | None = None, across_files: bool = False, exact: bool = True) -> DataFrame:
    """leaf, file, mn, mx, n, d, runs, combos and bloom of each leaf.

    ``d`` counts distinct leading keys and saturates; ``runs`` does not. ``combos``
    counts runs of all columns together. With ``across_files`` leaves ignore file ends,
    as if the projection were one long page sequence. Exact counts shuffle the distinct
    values of every leaf; estimates, which a build keeps, shuffle a few sketches a leaf.
    """
    size = leaf_rows or p.options.leaf_rows
    key = P.column(p.keys[0])
    rows = p.data().select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    combo = F.xxhash64(*[P.column(c) for c, t in p.types.items() if not t.startswith("map")])
    if across_files:
        # the rows before each file, as the manifest knows them; one row for each file
        ordered = sorted(p.files, key=lambda f: f.ordinal)
        before = list(accumulate((f.rows for f in ordered), initial=0))[:-1]
        offsets = p.spark.createDataFrame(list(zip((f.name for f in ordered), before)), "f string, before long")
        offsets = F.broadcast(offsets) if len(ordered) <= BROADCAST_FILES else offsets
        rows = rows.join(offsets, F.col("file") == F.col("f"))
        group = [F.floor((F.col("at") + F.col("before")) / size).alias("leaf")]
    else:
        group = [F.col("file"), F.floor(F.col("at") / size).alias("part")]
    distinct = F.count_distinct if exact else lambda c: F.least(F.approx_count_distinct(c, DISTINCT_ERROR), F.count(F.lit(1)))
    measures = [
        F.min(key).alias("mn"),
        F.max(key).alias("mx"),
        F.count(F.lit(1)).alias("n"),
        distinct(key).alias("runs"),
        distinct(combo).alias("combos"),
    ]
    if p.options.build_bloom_filters:
        measures.append(sketches.bloom(key, p.options.bloom_nhash).alias("bloom"))
    leaves = rows.groupBy(*group).agg(*measures)
    if not p.options.build_bloom_filters:
        leaves = leaves.withColumn("bloom", F.lit(None).cast("long"))
    leaves = leaves.withColumn("d", sketches.saturated(F.col("runs")))
    if across_files:
        return leaves
    per_file = leaves.groupBy("file").agg(F.count(F.lit(1)).alias("k"))
    place = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file")  # one row for each file
    first = per_file.select(F.col("file").alias("f"), (F.sum("k").over(place) - F.col("k")).alias("first"))
    numbered = leaves.join(first, F.col("file") == F.col("f")).withColumn("leaf", F.col("first") + F.col("part"))
    return numbered.select("leaf", "file", "mn", "mx", "n", "d", "runs", "combos", "bloom")


def upper_level(leaves: DataFrame, fanout: int) -> DataFrame:
    """One level up: ranges, sums and filters of ``fanout`` neighbours together."""
    out = leaves.groupBy(F.floor(F.col("leaf") / fanout).alias("leaf")).agg(
        F.min("mn").alias("mn"),
        F.max("mx").alias("mx"),
        F.sum("n").alias("n"),
        sketches.saturated(F.sum("d")).alias("d"),
        F.bit_or("bloom").alias("bloom"),
    )
    return out


def levels(p: Projection) -> list[DataFrame]:
    """All levels above the leaves, up to a single root."""
    out, nodes = [], p.leaves().count()
    level = p.leaves()
    while nodes > 1:
        level = upper_level(level, p.options.fanout)
        nodes = -(-nodes // p.options.fanout)
        out.append(level)
    return out


def kept_leaves(p: Projection, *preds: P.Predicate | list, leaves: DataFrame | None = None) -> DataFrame:
    """Leaves that can hold a matching row, by range and Bloom filter of the leading key.

    Pruning never loses rows: what the statistics cannot decide is kept.
    """
    found = p.leaves() if leaves is None else leaves
    if not p.options.zone_maps:
        return found
    for q in P.flatten(preds):
        if q.column != p.keys[0]:
            continue
        if isinstance(q, P.Null):
            found = found.where(F.lit(not q.wanted))
        elif isinstance(q, P.In):
            hits = [_can_equal(p, v) for v in q.values if v is not None]
            test = F.lit(False)
            for h in hits:
                test |= h
            found = found.where(test)
        elif q.value is None:
            found = found.where(F.lit(False))
        elif q.op == "=":
            found = found.where(_can_equal(p, q.value))
        elif q.op in (">", ">="):
            found = found.where(F.col("mx") > F.lit(q.value) if q.op == ">" else F.col("mx") >= F.lit(q.value))
        else:
            found = found.where(F.col("mn") < F.lit(q.value) if q.op == "<" else F.col("mn") <= F.lit(q.value))
    return found


def _can_equal(p: Projection, value):
    inside = (F.col("mn") <= F.lit(value)) & (F.col("mx") >= F.lit(value))
    if not p.options.bloom_filters:
        return inside
    typed = F.lit(value).cast(p.types[p.keys[0]])
    return inside & sketches.might_contain(F.col("bloom"), typed, p.options.bloom_nhash)


def inspect(p: Projection) -> DataFrame:
    """One row: leaves, how many pay off as runs of keys or of whole rows, their share, rows, files and bytes."""
    key, row = p.key_bytes(), p.row_bytes()
    limit = p.options.rle_uniqueness_threshold
    by_key = sketches.is_run_coded(F.col("runs"), F.col("n"), key, limit)
    by_row = sketches.is_run_coded(F.col("combos"), F.col("n"), row, limit) if p.include else F.lit(False)
    return p.leaves().agg(
        F.count(F.lit(1)).alias("leaves"),
        F.count_if(by_key).alias("key_run_leaves"),
        F.count_if(by_row).alias("include_run_leaves"),
        F.coalesce(F.round(100.0 * F.count_if(by_key | by_row) / F.count(F.lit(1)), 2), F.lit(0.0)).alias("run_percent"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(p.files)).alias("files"),
        F.lit(p.bytes).cast("long").alias("bytes"),
    )


def profile(df: DataFrame) -> dict:
    """Run ``df`` and report what its scans did: seconds, rows out, and for each scan its SQL metrics."""
    began = time.perf_counter()
    plan = df._jdf.queryExecution()
    rows = plan.toRdd().count()
    out = {"seconds": time.perf_counter() - began, "rows": rows, "scans": []}
    text = plan.executedPlan().toString()
    for found in re.finditer(r"PushedFilters: \[(.*?)\](?:.*?ReadSchema: (struct<.*?>))?", text):
        out["scans"].append({"pushed": found[1], "schema": found[2]})

    def walk(node):
        children = node.children()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            walk(node.finalPhysicalPlan())
        elif name.endswith("QueryStage"):
            walk(node.plan())
        if name.startswith("Scan"):
            metrics = node.metrics()
            out.setdefault("metrics", []).append(
                {k: metrics.apply(k).value() for k in ("numFiles", "numOutputRows", "filesSize", "scanTime") if metrics.contains(k)}
            )
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan.executedPlan())
    return out
