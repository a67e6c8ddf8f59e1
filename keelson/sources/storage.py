"""The folder that driver and executors share, and small files in it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset.

    Then it is a temporary folder if all of Spark runs in this process, and otherwise one
    beside a warehouse that is no local path. A local path on a cluster is refused: each
    machine has its own, and what an executor wrote there is lost with it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        alone = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not alone and re.match(r"(file:|/|[^:]*$)", warehouse):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="keelson-") if alone else f"{warehouse}/_keelson"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)


def file_bytes(spark: SparkSession, path: str) -> dict[str, int]:
    """Name and size of each Parquet file directly in ``path``."""
    fs, at = _path(spark, path)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _path(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _path(spark, path)
    source = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
