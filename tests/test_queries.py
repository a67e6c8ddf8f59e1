"""Every registered query with SQL gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import shutil
import subprocess
import sys
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest

from keelson.plans import benchmark, catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v.isoformat() if isinstance(v, datetime | date) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, tables, name):
    got = catalogue.QUERIES[name](spark, str(DATA))
    want = tables.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    mine = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert mine == theirs


def test_tables_answer_as_projections(spark):
    """The benchmark times the same rows over tables and over projections."""
    for name in sorted(set(benchmark.HEADLINE) - benchmark.PROJECTION_ONLY):
        forms = benchmark.table_form(spark, str(DATA), name), catalogue.QUERIES[name](spark, str(DATA))
        table, projection = (sorted(f.select(*sorted(f.columns)).collect(), key=repr) for f in forms)
        assert table == projection, name
        assert all(benchmark.files_bytes(f) > 0 for f in forms)
    found = benchmark.against_tables(spark, str(DATA), {"hot_metric": benchmark.Timing([1e9]), "uuid_range": benchmark.Timing([1.0])}, 1)
    assert list(found) == ["hot_metric"] and "slower" in found["hot_metric"]["advice"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["l_orderkey", "l_linenumber", "l_suppkey"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_parts(tmp_path):
    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "keelson", tmp_path / "keelson", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and 'pipeline' not in e.queries() and len(e.oracle_sql()) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path)}, check=True)


def test_shared_folder(spark, tmp_path, monkeypatch):
    from keelson.sources import storage

    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    storage.write_text(spark, f"{tmp_path}/a/b.json", "é")
    assert storage.exists(spark, f"{tmp_path}/a/b.json") and storage.read_text(spark, f"{tmp_path}/a/b.json") == "é"
    storage.delete(spark, f"{tmp_path}/a")
    assert not storage.exists(spark, f"{tmp_path}/a")
