"""Refresh of projections from a stream of batches.

A projection is an immutable snapshot, so a stream does not append to one: each batch
yields a new snapshot in a folder of its own, and readers open the latest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from keelson.sources import storage
from keelson.sources.projection import Projection, build_projection


def rebuild_on_batch(base: str, keys: list[str], include: list[str] = (), **how) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that builds ``{base}/{batch}`` from each batch.

    A batch that is delivered again replaces what an interrupted run left of it.
    """

    def run(df: DataFrame, batch: int) -> None:
        path = f"{base}/{batch:012d}"
        if storage.exists(df.sparkSession, f"{path}/manifest.json"):
            return
        if storage.exists(df.sparkSession, path):
            storage.delete(df.sparkSession, path)
        built: Projection = build_projection(df, path, keys, include, **how)
        assert built.path == path

    return run
