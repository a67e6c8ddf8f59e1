"""The corpus pipeline: rules, near-duplicates, decontamination, mixing and shards.

Each stage reads what its predecessor wrote and returns the table that the next one
reads; all but the last return the columns of documents.

Defined cases, from those of the operators: a document without words fails the rules
and goes; of a group of near-duplicates the one with the smallest key stays, and one
without a key always stays; a row is judged for leaks by its own text; a document is
mixed in up to three times, each copy being a row with a place of its own; a null
source is a source; empty tables stay empty; further columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import decontam, mixing, near_dup, quality_rules, sharding
from keelson.llm.common import discard, materialize, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_dup", near_dup.stage),
    ("decontamination", decontam.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: Fingerprints, alignments and the Feistel shuffle have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it."""
    source = table(spark, sf_dir, "documents")
    docs = source
    for _, apply in STAGES:
        before, docs = docs, materialize(apply(spark, docs, sf_dir))
        if before is not source:  # what a later stage has read goes at once
            discard(before)
    return docs
