"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``MAX_BITS`` = 2 bits agree in at
least 8 - 2 = 6 of their 8 bytes. The index therefore lists fingerprints under pairs
of byte-position groups: of the four groups of two positions at least two agree
whole, so any linked pair meets in at least one of the six lists made of two groups
(32 bits each, so lists stay short on large inputs). Pairs that meet are tallied over
all eight positions, those below six shared bytes are dropped, and the rest verified
by the number of differing bits.

Copies collapse first: the index holds distinct fingerprints. A list longer than
``LONG_LIST`` is not paired but resolved in linear time: its members agree in four
bytes, and two of them are linked exactly if they share a point within one bit of
both, so each member is linked to the smallest one that shares a point with it.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; rows with equal fingerprints form one component; repeated rows give repeated
results; a null doc_id never becomes a component id unless all its members are null;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import near_copies
from keelson.llm.common import broadcast_if_small, materialize, per_document, table
from keelson.llm.components import components
from keelson.llm.simhash import fingerprints

MAX_BITS = 2
LONG_LIST = 256
GROUPS = ((0, 1), (2, 3), (4, 5), (6, 7))


def _make():
    return lambda texts: {"fp": fingerprints(texts)}


def _byte(column: str, position: int):
    return F.shiftrightunsigned(column, 8 * position).bitwiseAND(F.lit(255))


def _mask(groups: tuple) -> int:
    bits = sum(0xFF << (8 * p) for g in groups for p in g)
    return bits - 2**64 if bits >= 2**63 else bits


def link(fps: DataFrame) -> DataFrame:
    """Links (a, b) over distinct fingerprints ``fp`` that connect all pairs within two bits."""
    pairs_of_groups = list(combinations(GROUPS, 2))
    keys = F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("k")) for i, g in enumerate(pairs_of_groups)
    ])
    index = fps.select("fp", F.explode(keys).alias("key")).select("fp", "key.t", "key.k")
    lists = index.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(index.join(lists, ["t", "k"]))
    short = members.where(F.col("n") <= LONG_LIST).select("t", "k", "fp")
    other = short.select("t", "k", F.col("fp").alias("other"))
    shared = sum((_byte("fp", p) == _byte("other", p)).cast("int") for p in range(8))
    met = short.join(other, ["t", "k"]).where(F.col("fp") > F.col("other"))
    exact = met.where(shared >= 8 - MAX_BITS).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MAX_BITS)
    links = exact.select(F.col("fp").alias("a"), F.col("other").alias("b"))

    long = members.where(F.col("n") > LONG_LIST)
    if not long.limit(1).count():
        return links
    flips = F.array(*[
        F.array(F.lit(0).cast("long"), *[
            F.lit(_signed(1 << bit)) for bit in range(64) if not (_mask(g) >> bit) & 1
        ]) for g in pairs_of_groups
    ])
    points = long.withColumn("flip", F.explode(F.element_at(flips, F.col("t") + 1)))
    points = points.select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("p"))
    stars = points.groupBy("t", "p").agg(F.min("fp").alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    near = points.join(stars, ["t", "p"]).where(F.col("fp") != F.col("m"))
    return links.union(near.select(F.col("fp").alias("a"), F.col("m").alias("b")))


def _signed(bits: int) -> int:
    return bits - 2**64 if bits >= 2**63 else bits


def group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component) for every row of ``docs``; the component is its smallest key."""
    marked = materialize(per_document(docs, [key], text, "fp long", _make).toDF("doc", "fp"))
    return _named(marked, link)


def group_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``group``, by the same method for near copies: ``near_copies`` has the SimHash, lists and tally.

    ``fp`` is the hash of the text and links join similar texts.
    """
    marked = near_copies.mark(docs, key, text)
    return _named(marked, lambda _: near_copies.link(docs, marked, text))


def _named(marked: DataFrame, link_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc, fp, component) of rows (doc, fp), given links (a, b) over distinct ``fp``."""
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc").alias("least"), F.count("*").alias("n")))
    roots = components(link_of(nodes.select("fp")))
    members = roots.union(roots.select("root", "root").distinct())
    # Only fingerprints with links or copies need a lookup; all others name themselves.
    members = broadcast_if_small(materialize(members.toDF("node", "root")))
    linked = nodes.join(members, F.col("fp") == F.col("node")).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select("fp", "component")
    copies = nodes.where("n > 1").join(members, F.col("fp") == F.col("node"), "left_anti").select("fp", "least")
    named = materialize(linked.union(copies).toDF("f", "component"))
    found = marked.join(broadcast_if_small(named), F.col("fp") == F.col("f"), "left")
    return found.select("doc", "fp", F.coalesce("component", "doc").alias("component"))


def op9_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group(docs).select(
        F.col("doc").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one whose key names the group.

    Near copies are texts whose five-word shingles have a Jaccard similarity of 0.8 or
    more (``near_copies``); the two bits of op9 bind that query alone.

    Rows that repeat a key stay or go together. A row without a key stays, as no key
    could name it among those to drop.
    """
    groups = group_copies(docs)
    gone = materialize(groups.where(F.col("doc") != F.col("component")).select(F.col("doc").alias("gone")).distinct())
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("key"))
    kept = rows.join(broadcast_if_small(gone), F.col("key") == F.col("gone"), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names])
