"""Scans: every predicate form, both directions, and cases that are easy to get wrong."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.functions.types import uuid_text
from keelson.operators.predicates import Compare, In, Param, between, bounds, eq, flatten, ge, gt, is_not_null, is_null, isin, le, lt
from keelson.operators.scan import Cursor, Edges, NotCovered, PreparedScan, _ends, files_for, lookup_join, scan
from keelson.operators.statistics import kept_leaves, profile
from keelson.plans.options import ProjectionOptions
from keelson.sources.projection import FileRange, build_projection

SMALL = ProjectionOptions(leaf_rows=64)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("scans")


@pytest.fixture(scope="module")
def signed(spark, folder):
    df = spark.range(-50_000, 50_001).select(F.col("id").cast("int").alias("a"))
    return build_projection(df, str(folder / "signed"), ["a"], options=SMALL, partitions=6)


@pytest.fixture(scope="module")
def pairs(spark, folder):
    df = spark.range(1, 101).select(*[F.col("id").cast("int").alias("k1"), (F.col("id") * 10).cast("int").alias("k2"), (F.col("id") * 100).cast("int").alias("v")])
    return build_projection(df, str(folder / "pairs"), ["k1", "k2"], ["v"], options=SMALL, partitions=3)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_negative_keys_with_upper_bound_only(signed):
    assert scan(signed, lt("a", -25_000)).count() == 25_000
    assert scan(signed).count() == 100_001


def test_short_negative_keys(spark, folder):
    df = spark.range(-16_383, 15_617).select(F.col("id").cast("short").alias("a"))
    p = build_projection(df, str(folder / "short"), ["a"], partitions=4)
    assert scan(p, lt("a", -10_000)).count() == 6_383


def test_uuid_from_the_least_value(spark, folder):
    df = spark.range(5000).select(uuid_text(F.md5(F.col("id").cast("string").cast("binary"))).alias("u"))
    p = build_projection(df, str(folder / "uuid"), ["u"], declared={"u": "uuid"}, partitions=4)
    assert scan(p, ge("u", "00000000-0000-0000-0000-000000000000")).count() == 5000


def test_two_keys_backward_with_bounds(pairs):
    got = values(scan(pairs, gt("k1", 50), lt("k1", 61), lt("k2", 550), order="desc"))
    assert got == [(k, 10 * k, 100 * k) for k in (54, 53, 52, 51)]


def test_text_first_key_backward_and_equal(spark, folder):
    rows = [("abc", 1, 10), ("abc", 3, 30), ("abc", 2, 20), ("foo", 1, 5), ("foo", 9, 6), ("zzz", 4, 7)]
    df = spark.createDataFrame(rows, "k1 string, k2 int, v int")
    p = build_projection(df, str(folder / "text"), ["k1", "k2"], ["v"], partitions=3)
    assert [r[1] for r in values(scan(p, eq("k1", "abc"), order="desc"))] == [3, 2, 1]
    bare = build_projection(df, str(folder / "text2"), ["k1", "k2"])
    assert scan(bare, eq("k1", "foo")).count() == 2


def test_counts_do_not_vary(spark, folder):
    df = spark.range(100_000).select((F.col("id") % 10).cast("int").alias("k"), F.col("id").cast("int").alias("v"))
    p = build_projection(df, str(folder / "counts"), ["k"], ["v"], partitions=5)
    assert {scan(p, ge("k", 5)).count() for _ in range(3)} == {50_000}
    assert scan(p, eq("k", 1)).count() == 10_000


def test_keys_beyond_32_bits(spark, folder):
    df = spark.range(1000).select((F.col("id") * 2**33 - 2**40).alias("k"))
    p = build_projection(df, str(folder / "long"), ["k"], options=SMALL, partitions=4)
    assert scan(p, gt("k", 2**35)).count() == sum(i * 2**33 - 2**40 > 2**35 for i in range(1000))


def test_floats_order_nan_last(spark, folder):
    df = spark.createDataFrame([(x,) for x in (1.5, float("nan"), -2.0, float("inf"), 0.0)], "k double")
    p = build_projection(df, str(folder / "nan"), ["k"], partitions=2)
    got = [r[0] for r in values(scan(p, order="asc"))]
    assert got[:4] == [-2.0, 0.0, 1.5, float("inf")] and got[4] != got[4]
    assert scan(p, gt("k", 1.0)).count() == 3


def test_several_bounds_of_one_side_all_hold(signed):
    assert [r[0] for r in values(scan(signed, gt("a", 5), gt("a", 7), le("a", 9), lt("a", 20), order="asc"))] == [8, 9]
    assert scan(signed, gt("a", 9), lt("a", 9)).count() == 0


def test_second_key_of_every_type(spark, folder):
    df = spark.range(20).select(
        F.lit(1).alias("k"), (F.col("id") % 2 == 0).alias("b"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("d"), F.col("id").cast("float").alias("f")
    )
    for c, v in (("b", True), ("d", __import__("datetime").date(2024, 1, 5)), ("f", 7.0)):
        p = build_projection(df, str(folder / f"second_{c}"), ["k", c])
        assert scan(p, eq("k", 1), eq(c, v)).count() == (10 if c == "b" else 1)


def test_one_byte_and_wide_includes_survive(spark, folder):
    df = spark.range(1000).select((F.col("id") % 7).cast("int").alias("k"), (F.col("id") % 2 == 0).alias("flag"), uuid_text(F.md5(F.col("id").cast("string").cast("binary"))).alias("u"))
    p = build_projection(df, str(folder / "include"), ["k"], ["flag", "u"], declared={"u": "uuid"})
    assert sorted(values(scan(p))) == sorted(values(df))


def test_backward_equality_below_the_largest_key(pairs):
    assert values(scan(pairs, eq("k1", 30), order="desc", columns=["k2"])) == [(300,)]


def test_null_forms(signed):
    assert scan(signed, eq("a", None)).count() == 0
    assert sorted(r[0] for r in values(scan(signed, isin("a", 1, None, 3)))) == [1, 3]
    assert scan(signed, isin("a", None)).count() == 0
    assert scan(signed, is_null("a")).count() == 0 and scan(signed, is_not_null("a")).count() == 100_001


def test_uncovered_columns(pairs):
    with pytest.raises(NotCovered, match="other"):
        scan(pairs, columns=["other"])
    with pytest.raises(NotCovered):
        scan(pairs, eq("other", 1))


def test_prepared_and_rescan(pairs):
    prepared = PreparedScan(pairs, ge("k1", Param("low")), isin("k2", Param("x"), 40), columns=["k1"])
    assert sorted(values(prepared.run(low=1, x=20))) == [(2,), (4,)]
    assert values(prepared.run(low=3, x=20)) == [(4,)]


def test_cursor_scrolls(pairs):
    cursor = Cursor(pairs, le("k1", 10), columns=["k1"])
    k = lambda rows: [r[0] for r in rows]
    assert k(cursor.forward(3)) == [1, 2, 3]
    assert k(cursor.backward(2)) == [2, 1]
    cursor.move(5)
    assert k(cursor.forward(2)) == [7, 8]
    assert k(cursor.forward(9)) == [9, 10]
    assert k(cursor.backward(1)) == [10]


def test_lookup_join(spark, pairs):
    outer = spark.createDataFrame([(3, "x"), (200, "y"), (5, "z")], "id int, tag string")
    assert sorted(values(lookup_join(outer, pairs, {"id": "k1"}, ["k2", "v"]))) == [(3, "x", 30, 300), (5, "z", 50, 500)]


def test_reads_only_files_in_range_and_columns_asked_for(signed, pairs):
    assert len(files_for(signed, [eq("a", 7)])) == 1
    assert files_for(signed, [eq("a", 10**6)]) == []
    plan = scan(pairs, eq("k1", 5), columns=["v"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k1,5)" in plan and "k2" not in plan.split("ReadSchema")[1]
    report = profile(scan(signed, between("a", 10, 20)))
    assert report["rows"] == 11 and report["metrics"][0]["numFiles"] == 1


def test_ordered_limit_reads_the_end_only(signed):
    tail = scan(signed, order="desc", limit=10)
    assert [r[0] for r in values(tail)] == list(range(50_000, 49_990, -1))
    assert len(tail.inputFiles()) == 1
    assert [r[0] for r in values(scan(signed, order="asc", limit=3, offset=2))] == [-49_998, -49_997, -49_996]


def test_hot_key_over_several_files(spark, folder):
    df = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(50_000).alias("a"), F.col("id").alias("x"))
    p = build_projection(df, str(folder / "hot"), ["a"], ["x"], partitions=8)
    assert sum(f.high == 50_000 for f in p.files) > 3 and max(f.rows for f in p.files) < 6_000
    assert scan(p, eq("a", 50_000)).count() == 15_000
    top = [tuple(r) for r in scan(p, order="desc", then=["x"], limit=5).collect()]
    assert top == [(50_000, x) for x in (19_999, 19_998, 19_997, 19_995, 19_994)]


def test_settings_change_no_result(spark, folder, signed):
    plain = build_projection(
        scan(signed), str(folder / "plain"), ["a"], options=ProjectionOptions(zone_maps=False, bloom_filters=False, build_bloom_filters=False), partitions=3
    )
    for preds in ([between("a", -5, 5)], [eq("a", 77)], [isin("a", 1, 99_999)], [lt("a", -49_000)]):
        assert sorted(values(scan(plain, *preds))) == sorted(values(scan(signed, *preds)))
    assert kept_leaves(plain, eq("a", 1)).count() == plain.leaves().count()


_PREDICATES = st.lists(
    st.one_of(
        st.builds(Compare, st.just("a"), st.sampled_from(["=", "<", "<=", ">", ">="]), st.integers(-60_000, 60_000)),
        st.builds(lambda v: In("a", tuple(v)), st.lists(st.one_of(st.none(), st.integers(-60_000, 60_000)), max_size=4)),
    ),
    max_size=3,
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_PREDICATES)
def test_pruning_never_loses_rows(signed, preds):
    whole = range(-50_000, 50_001)
    tests = {"=": int.__eq__, "<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}
    ok = lambda a: all(a in p.values if isinstance(p, In) else tests[p.op](a, p.value) for p in preds)
    wanted = sum(map(ok, whole))
    assert scan(signed, preds).count() == wanted
    kept = kept_leaves(signed, preds)
    assert (kept.agg(F.sum("n")).first()[0] or 0) >= wanted


def test_bounds_of_a_conjunction():
    b = bounds([gt("a", 5), ge("a", 5), lt("a", 9), isin("a", 6, 12)], "a")
    assert (b.low, b.low_open, b.high, b.high_open, b.points) == (5, True, 9, True, [6, 12])
    assert b.misses(7, 8) and not b.misses(6, 8) and b.misses(0, 5)
    assert bounds([eq("a", 1), eq("a", 2)], "a").empty


def test_files_beyond_a_hundred_thousand():
    """Ranges of more files than five digits number, in both directions, against a full look at each."""
    n = 120_000
    files = [FileRange(f"part-{i:05}-x-c000.snappy.parquet", 10, 2 * i, 2 * i + (2 if i % 7 == 0 else 1)) for i in range(n)]
    rng = random.Random(3)
    mixed = list(files)
    rng.shuffle(mixed)
    edges = Edges(mixed)
    assert edges.sorted and edges.files == files
    asked = [[eq("a", 2 * n - 1)], [ge("a", 2 * n - 9)], [gt("a", 14), lt("a", 30)], [isin("a", 1, 14, 199_999, 10**9)], [between("a", 9, 5)], [ge("a", 199_990), le("a", 200_010)]]
    for preds in asked:
        limits = bounds(flatten(preds), "a")
        assert edges.matching(limits) == [f for f in files if not limits.misses(f.low, f.high)]
    assert [f.name for f in _ends(mixed, 15, True)][:2] == [files[-1].name, files[-2].name]
    assert _ends(mixed, 5, False)[0] == files[0] and len(_ends(mixed, 5, True)) <= 3
    inside = bounds(flatten([ge("a", 200_001)]), "a")
    assert [f.low for f in _ends(edges.matching(inside), 15, False, inside)][:3] == [200_000, 200_002, 200_004]


def test_ordered_limit_inside_a_range_reads_few_files(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").cast("int").alias("a"), (F.col("id") * 3).alias("b"))
    p = build_projection(df, str(tmp_path / "p"), ["a"], ["b"], partitions=40)
    for order, first in (("asc", 1000), ("desc", 2999)):
        found = scan(p, between("a", 1000, 2999), order=order, limit=30)
        assert len(found.inputFiles()) < 5
        rows = [r.a for r in found.collect()]
        assert rows == list(range(1000, 1030)) if order == "asc" else rows == list(range(2999, 2969, -1))
        assert rows[0] == first
