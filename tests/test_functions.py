"""Types, decimals, Bloom filters, run decisions, leaf levels, chooser, benchmark."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keelson.functions import sketches, types
from keelson.operators.predicates import eq, ge
from keelson.operators.scan import scan
from keelson.operators.statistics import inspect, levels
from keelson.plans import benchmark
from keelson.plans.chooser import choose, query
from keelson.plans.options import ProjectionOptions
from keelson.sources.projection import build_projection


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values))))
    return row.select(column).first()[0]


def test_registry_has_every_type():
    assert len(types.REGISTRY) == 22
    with pytest.raises(types.TypeError_):
        types.type_of(None, "bytea")


def test_canonical_forms(spark):
    u = "A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11"
    assert one(spark, types.uuid_text(F.col("x")), x=u) == u.lower()
    assert one(spark, types.mac_bytes(12)(F.col("x")), x="08:00:2b:01:02:ff") == bytes.fromhex("08002b0102ff")
    assert one(spark, types.lsn_number(F.col("x")), x="FFFFFFFF/FFFFFFFF") == Decimal(2**64 - 1)
    assert one(spark, types.lsn_number(F.col("x")), x="1/0") == Decimal(2**32)
    with pytest.raises(Exception, match="invalid value"):
        one(spark, types.uuid_text(F.col("x")), x="not a uuid")


def test_unsigned_range(spark):
    check = types.REGISTRY["oid"].canonical
    assert spark.range(1).select(check(F.lit(2**32 - 1))).first()[0] == 2**32 - 1
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(check(F.lit(2**32))).collect()


def test_interval_order(spark):
    key = types.interval_micros(F.col("m"), F.col("d"), F.col("u"))
    rows = [(1, 0, 0), (0, 30, 0), (0, 29, types.MICROS_PER_DAY), (0, 1, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "m int, d int, u long").select(key).collect()]
    assert got[0] == got[1] == got[2] == 30 * got[3]


def test_timetz_orders_by_instant_then_zone(spark, tmp_path):
    rows = [((200, 0),), ((100, 3600),), ((100, -3600),)]
    df = spark.createDataFrame(rows, "t struct<utc_us:long,zone:int>")
    p = build_projection(df, str(tmp_path / "t"), ["t"], declared={"t": "timetz"})
    assert [tuple(r.t) for r in scan(p, order="asc").collect()] == [(100, -3600), (100, 3600), (200, 0)]


@pytest.mark.parametrize("precision,width", [(1, 2), (4, 2), (5, 4), (9, 4), (10, 8), (18, 8), (19, 16), (38, 16)])
def test_numeric_width(precision, width):
    assert sketches.numeric_width(precision) == width


def test_numeric_conversions(spark):
    df = spark.createDataFrame([(Decimal("2.345"),), (Decimal("-2.345"),), (Decimal("123.456789"),)], "v decimal(12,6)")
    assert [r[0] for r in df.select(sketches.to_scaled_int(F.col("v"), 2)).collect()] == [235, -235, 12346]
    assert [r[0] for r in df.select(sketches.unbounded_numeric(F.col("v"))).collect()][2] == Decimal("123.4568")
    back = df.select(sketches.from_scaled_int(sketches.to_scaled_int(F.col("v"), 2), 9, 2))
    assert [r[0] for r in back.collect()] == [Decimal("2.35"), Decimal("-2.35"), Decimal("123.46")]
    with pytest.raises(ValueError):
        sketches.numeric_width(39)


@pytest.mark.parametrize("nhash", [1, 2, 3, 4])
def test_bloom_has_no_false_negative_and_rejects_some(spark, nhash):
    held = spark.range(5).agg(sketches.bloom(F.col("id"), nhash).alias("b")).first().b
    df = spark.range(1000).withColumn("b", F.lit(held)).withColumn("may", sketches.might_contain(F.col("b"), F.col("id"), nhash))
    assert df.where("id < 5 and not may").count() == 0
    assert df.where("not may").count() > 300
    assert spark.range(3).where(sketches.might_contain(F.lit(None).cast("long"), F.col("id"))).count() == 3


def test_run_coding_follows_duplicates(spark, tmp_path):
    options = ProjectionOptions(leaf_rows=1000)
    many = spark.range(5000).select((F.col("id") % 10).cast("int").alias("k"), F.lit(7).alias("v"))
    p = build_projection(many, str(tmp_path / "many"), ["k"], ["v"], options=options)
    row = inspect(p).first()
    assert row.key_run_leaves == row.include_run_leaves == row.leaves and row.run_percent == 100.0 and row.rows == 5000
    unique = build_projection(spark.range(5000).select(F.col("id").alias("k")), str(tmp_path / "unique"), ["k"], options=options)
    assert inspect(unique).first().key_run_leaves == 0


def test_levels_end_in_one_root(spark, tmp_path):
    options = ProjectionOptions(leaf_rows=100, fanout=4)
    p = build_projection(spark.range(5000).select(F.col("id").alias("k")), str(tmp_path / "p"), ["k"], options=options, partitions=3)
    up = levels(p)
    assert [x.count() for x in up][-1] == 1
    root = up[-1].first()
    assert (root.mn, root.mx, root.n) == (0, 4999, 5000)
    leaves = p.leaves().orderBy("leaf").collect()
    assert [r.leaf for r in leaves] == list(range(len(leaves))) and all(a.mx < b.mn for a, b in zip(leaves, leaves[1:]))


def test_chooser(spark, tmp_path):
    df = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") % 100).alias("b"), (F.col("id") * 3).alias("c"))
    by_a = build_projection(df, str(tmp_path / "a"), ["a"], ["b", "c"])
    by_b = build_projection(df, str(tmp_path / "b"), ["b"], ["a", "c"])
    part = build_projection(df, str(tmp_path / "part"), ["a"], ["b"], where="b = 7")
    every = [by_a, by_b, part]
    assert choose(every, ["c"], eq("a", 5)).projection is by_a
    assert choose(every, ["c"], eq("b", 5)).projection is by_b
    assert choose(every, ["b"], ge("a", 5), conditions=["B  =  7"]).projection is part
    assert choose(every, ["b"], ge("a", 5)).projection is not part
    assert choose(every, ["missing"]).projection is None
    assert query(df, every, ["a"], ge("a", 5000), conditions=["b = 7"]).count() == 50
    assert query(df, [by_a], ["a"], ge("a", 5000), conditions=["b = 7"]).count() == 50
    assert query(df, [], ["a"], ge("a", 5000), conditions=["b = 7"]).count() == 50


def test_benchmark_figures():
    t = benchmark.Timing([0.4, 0.1, 0.2, 0.3])
    assert t.summary() == {"p50": 0.2, "p95": 0.4, "p99": 0.4, "avg": 0.25, "min": 0.1, "max": 0.4}
    assert list(benchmark.regressions({"a": 1.0, "b": 1.0}, {"a": 1.1, "b": 1.2, "c": 9.0})) == ["b"]
    assert benchmark.advice(3, 1, 1, 1).endswith("much faster") and benchmark.advice(1, 1, 9, 1).endswith("much smaller")
    assert benchmark.advice(1.25, 1, 1, 1).endswith(": faster") and "slower" in benchmark.advice(1, 2, 1, 1) and "little" in benchmark.advice(1, 1, 1, 1)
    assert "| q | 200.0" in benchmark.report({"q": benchmark.Timing([0.2])})


def test_benchmark_names_are_registered():
    from keelson.plans import catalogue

    assert set(benchmark.HEADLINE) <= set(catalogue.QUERIES)
