"""Awkward documents that every operator has to survive."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, gone long, size string, k1 long, text_ string"
PROSE = "the quick brown fox jumps over the lazy dog while seven quiet owls watch from an old crooked tree near the river bank"


@pytest.fixture(scope="session")
def awkward_rows():
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    texts = [
        (1, PROSE),
        (2, PROSE),
        (2, PROSE),
        (3, None),
        (4, ""),
        (5, " \t\n \n"),
        (6, long),
        (None, PROSE.upper()),
        (None, None),
        (7, "short"),
        (8, "one two"),
        (9, "naïve café – ünïcödé 東京 text with odd spaces"),
        (10, "\n".join(["same line again and again with several words in it"] * 30)),
        (11, "zz " * 500),
        (12, PROSE + " " + "extra words here " * 3),
    ]
    rows = [(d, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "r", i, i, "big", i, "x") for i, (d, t) in enumerate(texts)]
    rows[2] = rows[1]  # a repeated row
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    spark.createDataFrame(awkward_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
