"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for all operators and stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keelson.llm import (
    decontam,
    line_dedup,
    mixing,
    near_dup,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    suffix_tree_lm,
    url_filter,
)

ITEMS = [(1, "seven quiet owls watch from an old crooked tree near the river"), (2, None), (3, "two words"), (None, ""), (4, "seven quiet owls watch from an old crooked tree near the river")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, awkward):
    base = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(base / "benchmark.parquet"))
    awkward.write.parquet(str(base / "documents.parquet"))
    return str(base)


def counted(df):
    return sorted(map(repr, (r.doc_id for r in df.select("doc_id").collect())))


def by_id(df, doc):
    return [r for r in df.collect() if r.doc_id == doc]


OPERATORS = {
    "quality_rules": lambda d: quality_rules.judge(d, ["doc_id"]),
    "sharding": lambda d: sharding.shard(d, ["doc_id"]),
    "mixing": lambda d: mixing.mix(d, ["doc_id"]),
    "near_dup": lambda d: near_dup.group(d).withColumnRenamed("doc", "doc_id"),
    "line_dedup": lambda d: line_dedup.dedup(d, ["doc_id"]),
    "secret_scan": lambda d: secret_scan.scan(d, ["doc_id"]),
    "suffix_tree_lm": lambda d: suffix_tree_lm.score(d, d, ["doc_id"]),
    "quality_classifier": lambda d: quality_classifier.score(d, d.select("text", (F.col("k1") % 2).cast("double").alias("label")), ["doc_id"]),
    "url_filter": lambda d: url_filter.judge(d.withColumn("url", F.col("text")), ["doc_id"], d.select("text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(awkward, nothing, name):
    out = OPERATORS[name](awkward)
    assert counted(out) == counted(awkward)
    twice = by_id(out, 2)
    same = [c for c in out.columns if c not in ("shard", "slot")]
    assert len(twice) == 2 and all(twice[0][c] == twice[1][c] for c in same)
    empty = OPERATORS[name](nothing)
    assert empty.columns == out.columns and empty.count() == 0


def test_decontamination(spark, awkward, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = [(r.doc, r.item) for r in decontam.find(awkward, items).collect()]
    assert sorted(found, key=repr) == sorted([(d, i) for d in (1, 2, 2, None, 12) for i in (1, 4)], key=repr)
    assert decontam.find(nothing, items).count() == 0
    assert decontam.find(awkward, items.limit(0)).count() == 0
    kept = decontam.clean(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 5


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_every_stage(spark, awkward, nothing, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, awkward, folder)
    assert out.columns[: len(awkward.columns)] == awkward.columns
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == awkward.columns
    rows = out.collect()
    known = {repr(tuple(r)) for r in awkward.collect()}
    assert rows and all(repr(tuple(r)[: len(awkward.columns)]) in known for r in rows)
    assert stage(spark, nothing, folder).count() == 0


def test_run_on_awkward_documents(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"shard", "slot"} <= set(out.columns)
    assert sorted(r.slot for r in out.collect())[0] == 0


def test_edge_values(awkward):
    scored = suffix_tree_lm.score(awkward, awkward, ["doc_id"]).collect()
    assert {r.n_tokens for r in scored if r.doc_id in (3, 4, 5)} == {1}
    assert len({r.score for r in scored if r.doc_id in (3, 4, 5)}) == 1
    rules = {r.doc_id: r for r in quality_rules.judge(awkward, ["doc_id"]).collect()}
    assert rules[3].base_failed and rules[4].n_words == 0 and rules[10].n_dup_lines == 29 and not rules[11].kept and rules[1].kept
    lines = {r.doc_id: r for r in line_dedup.dedup(awkward, ["doc_id"]).collect()}
    assert lines[3].clean_text is None and lines[3].n_lines == 0 and lines[4].n_lines == 1 and lines[5].n_lines == 3
    assert lines[10].removed_lines == 29
    taken = {r.doc_id: r for r in mixing.mix(awkward, ["doc_id"]).collect()}
    assert taken[3].size == taken[3].taken == taken[5].size == 0
    places = sharding.shard(awkward, ["doc_id"], shards=4).collect()
    assert {r.text_crc32 for r in places if r.doc_id in (3, 4)} == {0} and {r.size for r in places if r.doc_id in (3, 4)} == {16}
