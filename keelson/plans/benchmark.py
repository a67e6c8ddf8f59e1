"""Benchmark harness: warm-up and timed runs, percentiles, sizes, regressions, advice.

Projections are built before any query is timed and their build times are reported
apart. All runs share one session, so settings reach what is timed.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from keelson.plans import catalogue

#: From which ratio of base time to projection time a statement is made.
STRONG, MILD, MUCH_SMALLER, SLOWER, SLIGHTLY_SLOWER = 1.5, 1.2, 3.0, 0.8, 0.9
REGRESSION = 0.15

#: The registered queries that carry the benchmark's shapes.
HEADLINE = [
    "hot_metric",
    "metric_range",
    "recent_orders",
    "single_day",
    "hot_user_group",
    "user_range",
    "status_eq",
    "status_in",
    "point_lookup",
    "half_range",
    "sel_0_1_percent",
    "sel_10_percent",
    "include_0",
    "include_4",
    "desc_100",
    "desc_10k",
    "desc_range",
    "limit_10",
    "limit_1000",
    "range_limit",
    "covered_range",
    "covered_small",
    "active_eq",
    "active_range",
    "in_5",
    "in_50",
    "in_500",
    "full_aggregate",
    "consecutive_range_sums",
    "uuid_range",
    "text_range",
    "two_key_eq_range",
    "nested_loop_join",
]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
#: Queries whose SQL is not Spark's.
PROJECTION_ONLY = {"uuid_range"}


@dataclass
class Timing:
    """Seconds of the timed runs of one query."""

    runs: list[float] = field(default_factory=list)

    def percentile(self, share: float) -> float:
        ordered = sorted(self.runs)
        return ordered[max(0, math.ceil(share * len(ordered)) - 1)]

    def summary(self) -> dict[str, float]:
        out = {f"p{round(100 * q)}": self.percentile(q) for q in (0.5, 0.95, 0.99)}
        return out | {"avg": sum(self.runs) / len(self.runs), "min": min(self.runs), "max": max(self.runs)}


def timed(run: Callable[[], DataFrame], repeat: int, warm: int = 1) -> Timing:
    """Collected results, since that is what a client waits for."""
    out = Timing()
    for i in range(warm + repeat):
        began = time.perf_counter()
        run().collect()
        if i >= warm:
            out.runs.append(time.perf_counter() - began)
    return out


def build_all(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, float]]:
    """Build every registered projection: seconds, bytes and rows of each."""
    out = {}
    for name in catalogue.PROJECTIONS:
        began = time.perf_counter()
        p = catalogue.projection(spark, sf_dir, name)
        out[name] = {"seconds": time.perf_counter() - began, "bytes": p.bytes, "rows": p.rows}
    return out


def run(spark: SparkSession, sf_dir: str, names: list[str] = HEADLINE, repeat: int = 5) -> dict[str, Timing]:
    return {n: timed(lambda n=n: catalogue.QUERIES[n](spark, sf_dir), repeat) for n in names}


def table_form(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A registered query over the tables themselves, without any projection: its SQL on views of them."""
    sql = catalogue.ORACLE_SQL[name].replace(" // ", " div ")
    for table in TABLES:
        if table in sql:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


def files_bytes(df: DataFrame) -> int:
    """Bytes of the files that the scans of ``df`` are made of."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def against_tables(spark: SparkSession, sf_dir: str, timings: dict[str, Timing], repeat: int = 3) -> dict[str, dict]:
    """Median seconds over the tables for each timed query that has such a form, and what that says."""
    out = {}
    for name, timing in timings.items():
        if name in PROJECTION_ONLY:
            continue
        base = timed(lambda name=name: table_form(spark, sf_dir, name), repeat).percentile(0.5)
        sizes = [files_bytes(q) for q in (table_form(spark, sf_dir, name), catalogue.QUERIES[name](spark, sf_dir))]
        out[name] = {"table_seconds": base, "advice": advice(base, timing.percentile(0.5), sizes[0], max(1, sizes[1]))}
    return out


def regressions(before: dict[str, float], now: dict[str, float], limit: float = REGRESSION) -> dict[str, float]:
    """Queries that got slower by more than ``limit``, and by which share."""
    shares = {n: now[n] / before[n] - 1 for n in now if before.get(n)}
    return {n: s for n, s in shares.items() if s > limit}


def advice(base_seconds: float, projection_seconds: float, base_bytes: float, projection_bytes: float) -> str:
    """What the figures of a table scan and a projection scan say."""
    speed, size = base_seconds / projection_seconds, base_bytes / projection_bytes
    if speed >= STRONG:
        return "use the projection: much faster"
    if speed >= MILD:
        return "use the projection: faster"
    if size >= MUCH_SMALLER and speed >= SLIGHTLY_SLOWER:
        return "use the projection: much smaller"
    if speed < SLOWER:
        return "use the table: the projection is slower"
    return "either: little difference"


def report(timings: dict[str, Timing]) -> str:
    """A Markdown table of the summaries, in milliseconds."""
    lines = ["| query | p50 | p95 | p99 | avg | min | max |", "| --- | --- | --- | --- | --- | --- | --- |"]
    for n, t in timings.items():
        s = t.summary()
        lines.append(f"| {n} | " + " | ".join(f"{1000 * s[k]:.1f}" for k in ("p50", "p95", "p99", "avg", "min", "max")) + " |")
    return "\n".join(lines)
