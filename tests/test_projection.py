"""Building: shapes, limits, values, empties and the manifest."""

from __future__ import annotations

import warnings
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keelson.functions.types import TypeError_
from keelson.operators.predicates import between, eq, ge, is_not_null, lt
from keelson.operators.scan import scan
from keelson.plans.chooser import query
from keelson.plans.options import OptionError, ProjectionOptions
from keelson.sources import storage
from keelson.sources.projection import ProjectionError, build_projection, open_projection, validate_schema


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "p")


def numbers(spark, n=1000):
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("a"), (F.col("id") * 2).cast("int").alias("b"))


def test_round_trip_and_reopen(spark, path):
    built = build_projection(numbers(spark), path, ["a"], ["b"], partitions=4)
    again = open_projection(spark, path)
    assert again.rows == built.rows == 1000 and again.columns == ["a", "b"]
    assert [(f.name, f.rows, f.low, f.high) for f in again.files] == [(f.name, f.rows, f.low, f.high) for f in built.files]
    assert sum(r.b for r in scan(again, between("a", 10, 20)).collect()) == 2 * sum(range(10, 21))


def test_files_are_sorted_and_disjoint(spark, path):
    p = build_projection(numbers(spark).orderBy(F.rand(3)), path, ["a"], partitions=5)
    assert len(p.files) > 1
    ordered = sorted(p.files, key=lambda f: f.name)
    assert all(x.high < y.low for x, y in zip(ordered, ordered[1:]))


@pytest.mark.parametrize("keys,include", [(["a"], []), (["a"], ["b"]), (["a", "b"], [])])
def test_empty(spark, path, keys, include):
    p = build_projection(numbers(spark).limit(0), path, keys, include)
    assert p.rows == 0 and scan(p, eq("a", 1)).count() == 0 and scan(p, order="desc", limit=3).count() == 0


def test_never_overwrites(spark, path):
    build_projection(numbers(spark), path, ["a"])
    with pytest.raises(ProjectionError, match="never changed"):
        build_projection(numbers(spark), path, ["a"])


def test_nulls_are_rejected_and_leave_nothing(spark, path):
    df = spark.createDataFrame([(1, 2), (None, 3)], "k int, v int")
    with pytest.raises(ProjectionError, match="column k has 1 NULL"):
        build_projection(df, path, ["k"], ["v"])
    with pytest.raises(ProjectionError, match="column v has 1 NULL"):
        build_projection(spark.createDataFrame([(1, None)], "k int, v int"), path, ["k"], ["v"])
    with pytest.raises(ProjectionError, match="holds no projection"):
        open_projection(spark, path)


def test_text_limit_counts_bytes(spark, path):
    fits = spark.createDataFrame([("é" * 16,)], "s string")
    assert build_projection(fits, path + "1", ["s"]).rows == 1
    with pytest.raises(ProjectionError, match="exceeds 32 bytes"):
        build_projection(spark.createDataFrame([("é" * 17,)], "s string"), path + "2", ["s"])
    lifted = build_projection(spark.createDataFrame([("x" * 99,)], "s string"), path + "3", ["s"], options=ProjectionOptions(strict=False))
    assert lifted.rows == 1


def test_shape_limits(spark):
    wide = spark.range(1).select(*[F.col("id").alias(f"c{i}") for i in range(20)])
    names = wide.columns
    assert len(validate_schema(wide, names[:1], names[1:17])) == 17
    with pytest.raises(ProjectionError, match="at most 16"):
        validate_schema(wide, names[:1], names[1:18])
    with pytest.raises(ProjectionError, match="at most 2"):
        validate_schema(wide, names[:3])
    assert validate_schema(wide, names[:3], options=ProjectionOptions(strict=False))
    with pytest.raises(ProjectionError, match="no such column"):
        validate_schema(wide, ["nope"])
    with pytest.raises(ProjectionError, match="only once"):
        validate_schema(wide, ["c0"], ["c0"])
    with pytest.raises(ProjectionError, match="at least one"):
        validate_schema(wide, [])


def test_type_limits(spark):
    df = spark.createDataFrame([(1, "x", bytearray(b"x"), Decimal("1.5"), [1])], "i int, s string, b binary, d decimal(9,2), l array<int>")
    with pytest.raises(ProjectionError, match="second key"):
        validate_schema(df, ["i", "s"])
    with pytest.raises(ProjectionError, match="cannot be a key"):
        validate_schema(df, ["d"])
    for c in ("b", "l"):
        with pytest.raises(TypeError_):
            validate_schema(df, [c])
    assert validate_schema(df, ["s", "i"], ["d"])["s"].name == "text"
    with pytest.raises(TypeError_):
        validate_schema(df, ["i"], declared={"i": "bytea"})


def test_wide_rows_warn(spark, path):
    wide = spark.range(3).select("id", *[F.lit("0" * 32).alias(f"u{i}") for i in range(16)])
    with pytest.warns(UserWarning, match="rows of about"):
        build_projection(wide, path, ["id"], wide.columns[1:])


def test_partial_and_stale(spark, path, tmp_path):
    source = str(tmp_path / "source")
    numbers(spark).write.parquet(source)
    df = spark.read.parquet(source)
    p = build_projection(df, path, ["a"], ["b"], where="a % 10 = 0")
    assert p.rows == 100 and open_projection(spark, path).where == "a % 10 = 0"
    assert not p.is_stale(spark.read.parquet(source))
    numbers(spark, 5).write.mode("append").parquet(source)
    assert p.is_stale(spark.read.parquet(source))


def test_stale_projection_is_passed_over(spark, path, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "a int, b int").coalesce(1).write.parquet(source)
    p = build_projection(spark.read.parquet(source), path, ["a"], ["b"])
    assert [r.b for r in query(spark.read.parquet(source), [p], ["b"], eq("a", 1)).collect()] == [1]
    file = next(Path(source).glob("*.parquet"))
    other = str(tmp_path / "other")
    spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "a int, b int").coalesce(1).write.parquet(other)
    file.write_bytes(next(Path(other).glob("*.parquet")).read_bytes())  # in place: same name, same rows
    for crc in Path(source).glob(".*.crc"):
        crc.unlink()
    spark.catalog.refreshByPath(source)
    now = spark.read.parquet(source)
    assert p.is_stale(now) and open_projection(spark, path).is_stale(now)
    assert [r.b for r in query(now, [p], ["b"], eq("a", 1)).collect()] == [10]


def test_sources_without_files_are_told_by_rows(spark, path):
    p = build_projection(numbers(spark, 30), path, ["a"])
    assert not p.is_stale(numbers(spark, 30)) and p.is_stale(numbers(spark, 31))


def test_view_and_dotted_names(spark, path):
    df = spark.range(20).select(F.col("id").alias("a.b"), (F.col("id") * 2).alias("c d"))
    p = build_projection(df, path, ["a.b"], ["c d"])
    got = scan(p, ge("a.b", 5), lt("a.b", 8), order="desc", columns=["c d"]).collect()
    assert [r[0] for r in got] == [14, 12, 10] and scan(p, is_not_null("a.b")).count() == 20
    p.view("dotted")
    assert spark.sql("select sum(`c d`) from dotted where `a.b` in (1, 2)").first()[0] == 6


def test_shared_folder_on_a_cluster_is_never_local(monkeypatch):
    class Held:
        isDefined = staticmethod(lambda: False)

    class Fake:
        class conf:
            get = staticmethod(lambda name, default=None: "file:/user/warehouse" if "warehouse" in name else None)

        class sparkContext:
            master = "spark://host:7077"
            setCheckpointDir = staticmethod(lambda path: None)

            class _jsc:
                sc = staticmethod(lambda: type("Sc", (), {"getCheckpointDir": staticmethod(lambda: Held)}))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Fake)
    monkeypatch.setattr(Fake.conf, "get", staticmethod(lambda name, default=None: "hdfs://nn/warehouse" if "warehouse" in name else None))
    assert storage.shared_folder(Fake) == "hdfs://nn/warehouse/_keelson"


def test_decimals_are_kept_exactly(spark, path):
    rows = [(1, Decimal("0.00")), (2, Decimal("-99999.99")), (3, Decimal("99999.99"))]
    p = build_projection(spark.createDataFrame(rows, "id int, v decimal(7,2)"), path, ["id"], ["v"])
    assert [tuple(r) for r in scan(p, order="asc").collect()] == rows


def test_collated_key(spark, path):
    names = ["zebra", "Äpfel", "apfel", "Zebra", "éclair", "eclair", "Eclair", "école"]
    p = build_projection(spark.createDataFrame([(n,) for n in names], "name string"), path, ["name"], collation="UNICODE")
    got = [r.name for r in scan(p, order="asc").collect()]
    assert got.index("apfel") < got.index("eclair") < got.index("zebra") and got.index("éclair") < got.index("zebra")
    assert scan(p, ge("name", "z")).count() == 2


def test_hot_key_and_parquet_bloom(spark, path):
    df = spark.range(20_000).select(F.lit(42).alias("a"), F.col("id").cast("int").alias("x"))
    p = build_projection(df, path, ["a"], ["x"], options=ProjectionOptions(parquet_bloom=True))
    assert scan(p, eq("a", 42)).count() == 20_000 and scan(p, eq("a", 41)).count() == 0


@pytest.mark.parametrize("bad", [{"bloom_nhash": 5}, {"leaf_rows": 0}, {"rle_uniqueness_threshold": 1.5}, {"cost_page": -1}, {"fanout": 1}])
def test_option_ranges(bad):
    with pytest.raises(OptionError):
        ProjectionOptions(**bad)


def test_no_warning_for_narrow_rows(spark, path):
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        build_projection(numbers(spark, 10), path, ["a"])


def test_rebuild_on_batch(spark, tmp_path):
    from keelson.streaming import rebuild_on_batch

    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    numbers(spark, 50).write.parquet(source)
    stream = spark.readStream.schema("a int, b int").parquet(source)
    query = stream.writeStream.foreachBatch(rebuild_on_batch(base, ["a"], ["b"])).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    p = open_projection(spark, f"{base}/{0:012d}")
    assert p.rows == 50
    rebuild_on_batch(base, ["a"], ["b"])(spark.read.parquet(source), 0)  # delivered again: nothing to do
