"""Near copies for the pipeline: SimHash, lists of byte positions, a tally, and exact Jaccard similarity.

Two texts are near copies if their sets of ``SHINGLE``-word shingles have a Jaccard
similarity of ``LIKE`` or more. The method is that of op9 with parameters for this limit:

* the fingerprint is a SimHash of ``WIDTH`` bytes over the shingles (a bit is set where
  over half of the shingles set it). Texts at 0.8 differ in 0.15 of the bits, so they share
  about a quarter of the bytes by position; unrelated ones share one of 256;
* the inverted index lists each text under the values of groups of three byte positions:
  ``WAYS`` divisions of all positions, 384 lists of 24 bits for each text. Under the model of
  independent bits 0.996 of pairs at 0.8 share a list, 0.999 at 0.82 and nearly all at 0.85;
* pairs that meet are tallied over all positions, and those with fewer than ``SHARED`` equal
  bytes are dropped (51 are expected at 0.8, deviation 6). Before that, so that chance
  meetings make no rows, the first eight bytes may differ in at most ``NEAR`` bits (9.7 are
  expected, deviation 2.9);
* what is left is verified on the shingles of the whole texts.

Equal texts collapse first: a text is known by its 64-bit hash. Texts that are in a list of
more than ``LONG_LIST`` are called busy. All pairs meet in a list but those of two busy
texts. Each busy text is first held against two others of its longest list: the member that
shares most with others (of copies that were edited apart from one original, the original or
the nearest to it), and that which comes first by a hash. Busy texts that are connected then
need not be compared; all pairs of them in a list, of any length, that are not yet, which
are the few outside of its largest component with each other and with the rest, meet too if
their sketches of ``SKETCH`` one-bit minima differ in at most ``APART``. Two texts at 0.8
differ in a tenth of the bits, and in more than ``APART`` of them with a probability of
0.00002; so a link between two components is as good as never left out, and pairs that only
share a list mostly end there. Comparing sketches still costs the product of the two sides
of a list, but no row, text or shuffle for each pair.

Defined cases: texts without words are copies of each other; a text of fewer than
``SHINGLE`` words is one shingle; a text of any length gives all its shingles; equal rows
share a node; a null text is an empty one; other columns are not read; an empty table has
no links. Bits of very short texts change more often, most at four against five shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import MOST_RANGES, broadcast_if_small, discard, materialize, per_document, texts_of
from keelson.llm.components import components
from keelson.llm.simhash import hashes

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
LIKE = (4, 5)
#: Bytes of a fingerprint, divisions of their positions into groups of three, and equal bytes that a pair needs.
WIDTH, WAYS, SHARED = 192, 6, 27
#: Bits of the first eight bytes that may differ.
NEAR = 22
LONG_LIST = 32
#: Entries of the index that one task sorts.
SORTED_ROWS = 4_000_000
#: Bits of a sketch, one for each of so many minima, and how many may differ: 205 are expected at ``LIKE``, 14 a deviation.
SKETCH, APART = 2048, 262
#: Shingles that are permuted at a time.
CHUNK = 1024

_rng = np.random.default_rng(7)
_BY = _rng.integers(0, 2**63, (3, WIDTH // 8), np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH_BY = _rng.integers(0, 2**63, (3, SKETCH), np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = [f"s{i}" for i in range(SKETCH // 64)]
_BYTES = [f"b{i}" for i in range(WIDTH // 8)]
#: The three byte positions of each list.
GROUPS = np.concatenate([_rng.permutation(WIDTH).reshape(-1, 3) for _ in range(WAYS)])
#: An entry of the index is one number: 9 bits of the list, 24 of its bytes, 31 of the hash of the text.
_NAME = 31
_NAMES = (1 << _NAME) - 1


def shingles(data: bytes) -> set[int]:
    return set(hashes(data, SHINGLE)) or {0}


def _minima(own: set[int], by: np.ndarray) -> np.ndarray:
    """The least shingle under each permutation, mixed."""
    values = np.fromiter(own, np.uint64, len(own))
    least = np.full(by.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), CHUNK):
        part = values[start : start + CHUNK, None] * by[0] + by[1]
        np.minimum(least, part.min(axis=0), out=least)
    least ^= least >> np.uint64(32)
    return least * by[2]


def fingerprint(own: set[int]) -> np.ndarray:
    """The SimHash of a set of shingles, eight bytes to a number: the bits that over half of the shingles set."""
    values = np.fromiter(own, np.uint64, len(own))
    counts = np.zeros(WIDTH * 8, np.int64)
    for start in range(0, len(values), 255):
        mixed = values[start : start + 255, None] * _BY[0] + _BY[1]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _BY[2]
        mixed ^= mixed >> np.uint64(32)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)  # up to 255 rows
    return np.packbits(2 * counts > len(values)).view(np.int64)


def entries(names: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The entries of texts, by their hashes and fingerprints, in all lists: an array of texts by lists."""
    found = np.arange(len(GROUPS), dtype=np.int64)[None, :]
    every = np.ascontiguousarray(prints).view(np.uint8)
    for i in range(3):
        found = found << 8 | every[:, GROUPS[:, i]]
    return found << _NAME | (names & _NAMES)[:, None]


def sketch(own: set[int]) -> np.ndarray:
    """One bit of each minimum, 64 to a number."""
    return np.packbits((_minima(own, _SKETCH_BY) >> np.uint64(63)).astype(bool)).view(np.int64)


def _make_sketch():
    def work(texts):
        found = np.array([sketch(shingles(t)) for t in texts])
        return {name: pa.array(found[:, i]) for i, name in enumerate(_WORDS)}

    return work


def _make():
    def work(texts):
        sets = [shingles(t) for t in texts]
        found = np.array([fingerprint(s) for s in sets])
        return {"size": [len(s) for s in sets]} | {name: pa.array(found[:, i]) for i, name in enumerate(_BYTES)}

    return work


def _node(text: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def mark(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, fp, size, b0, ...) of every row: key, hash of the text, number of shingles, SimHash."""
    named = docs.select(F.col(f"`{key}`").alias("doc"), _node(text).alias("fp"), F.col(f"`{text}`").alias("text"))
    columns = ", ".join(f"{b} long" for b in _BYTES)
    return materialize(per_document(named, ["doc", "fp"], "text", f"size int, {columns}", _make))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v) of texts (fp, b0, ...): their entries."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            names, *prints = (c.to_numpy() for c in batch.slice(start, 1024).columns)
            yield pa.RecordBatch.from_arrays([pa.array(entries(names, np.stack(prints, axis=1)).ravel())], names=["v"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted entries (v), each once, those whose list another entry shares."""
    last, met = np.empty(0, np.int64), False  # the entry still open and whether the one before shares its list
    for batch in batches:
        v = np.concatenate((last, batch.column(0).to_numpy()))
        if not v.size:
            continue
        same = (v[1:] >> _NAME) == (v[:-1] >> _NAME)
        keep = np.append(same, False)
        keep[1:] |= same
        keep[0] |= met
        once = np.append(v[1:] != v[:-1], True)
        yield pa.RecordBatch.from_arrays([pa.array(v[:-1][(keep & once)[:-1]])], names=["v"])
        last, met = v[-1:], bool(keep[-1])
    if met:
        yield pa.RecordBatch.from_arrays([pa.array(last)], names=["v"])


def _members(nodes: DataFrame) -> DataFrame:
    """(k, fp, size, b0, n): the distinct texts of each list that several share, and how many share it.

    Entries hold part of a hash only; where two texts agree in it both become members, which
    adds pairs to verify and loses none.
    """
    parts = max(1, min(MOST_RANGES, math.ceil(nodes.count() * len(GROUPS) / SORTED_ROWS)))
    index = nodes.select("fp", *_BYTES).mapInArrow(_index, "v long")
    index = index.repartition(parts, F.shiftright("v", _NAME)).sortWithinPartitions("v")
    shared = materialize(index.mapInArrow(_met, "v long"))
    slim = broadcast_if_small(nodes.select("fp", "size", "b0", F.col("fp").bitwiseAND(F.lit(_NAMES)).alias("name")))
    members = shared.select(F.shiftright("v", _NAME).alias("k"), F.col("v").bitwiseAND(F.lit(_NAMES)).alias("entry"))
    members = materialize(members.join(slim, F.col("entry") == F.col("name")).select("k", "fp", "size", "b0"))
    discard(shared)
    lists = materialize(members.groupBy(F.col("k").alias("l")).agg(F.count("*").alias("n")))
    found = materialize(members.join(broadcast_if_small(lists), F.col("k") == F.col("l")).drop("l"))
    discard(members)
    return found


def _pairs(left: DataFrame, right: DataFrame, test: Column) -> DataFrame:
    """Distinct pairs (a, b), a > b, of texts that share a list, differ little enough in size and bits, and pass ``test``."""
    other = right.select(F.col("k").alias("ok"), *[F.col(c).alias(f"other_{c}") for c in right.columns if c not in ("k", "n")])
    most, least = F.greatest("size", "other_size"), F.least("size", "other_size")
    near = F.bit_count(F.col("b0").bitwiseXOR(F.col("other_b0"))) <= NEAR
    found = left.join(other, (F.col("k") == F.col("ok")) & (LIKE[1] * least >= LIKE[0] * most) & near & test)
    return found.select(F.greatest("fp", "other_fp").alias("a"), F.least("fp", "other_fp").alias("b")).distinct()


def busy(members: DataFrame) -> DataFrame:
    """``members`` with ``busy``: whether the text is in a list of over ``LONG_LIST``."""
    of = materialize(members.where(F.col("n") > LONG_LIST).select(F.col("fp").alias("w")).distinct())
    found = members.join(broadcast_if_small(of), F.col("fp") == F.col("w"), "left")
    return materialize(found.withColumn("busy", F.col("w").isNotNull()).drop("w"))


def candidates(members: DataFrame) -> DataFrame:
    """All pairs of texts that are not both busy; each busy text with the two members drawn from its longest list."""
    few, long = members.where(F.col("n") <= LONG_LIST), members.where(F.col("n") > LONG_LIST)
    pairs = _pairs(few, few, (F.col("fp") > F.col("other_fp")) & ~(F.col("busy") & F.col("other_busy")))
    own = long.groupBy("fp").agg(F.sum("n").alias("weight"), F.max(F.struct("n", "k")).alias("longest"), F.collect_list("k").alias("ks"))
    own = materialize(own)
    most, first = F.max_by("fp", F.struct("weight", "fp")), F.min_by("fp", F.xxhash64("fp"))
    weighed = own.select(F.explode("ks").alias("ok"), "fp", "weight")
    chosen = materialize(weighed.groupBy("ok").agg(most.alias("r0"), first.alias("r1")))
    # One row a text, not one an entry, of which a text has up to len(GROUPS).
    held = own.select("fp", F.col("longest.k").alias("k")).join(broadcast_if_small(chosen), F.col("k") == F.col("ok"))
    drawn = held.select("fp", F.explode(F.array("r0", "r1")).alias("r")).where(F.col("fp") != F.col("r"))
    return pairs.unionByName(drawn.select(F.greatest("fp", "r").alias("a"), F.least("fp", "r").alias("b"))).distinct()


def unconnected(members: DataFrame, links: DataFrame, docs: DataFrame, text: str) -> DataFrame | None:
    """The pairs of busy texts that ``links`` do not connect and whose sketches are close; None if there are none."""
    long = members.where("busy")
    if not long.limit(1).count():
        return None
    roots = broadcast_if_small(materialize(components(links)))
    # Joined once a text, not once an entry: its lists, len(GROUPS) at most, are unfolded afterwards.
    own = long.groupBy("fp").agg(F.first("size").alias("size"), F.first("b0").alias("b0"), F.collect_list("k").alias("ks"))
    own = own.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    held = materialize(own.select(F.explode("ks").alias("k"), "fp", "size", "b0", "root"))
    held = held.withColumn("c", F.count("*").over(Window.partitionBy("k", "root")))
    of_list = Window.partitionBy("k")
    held = held.withColumn("main", F.max(F.struct("c", "root")).over(of_list).getField("root"))
    held = held.withColumn("lo", F.min("root").over(of_list)).withColumn("hi", F.max("root").over(of_list))
    held = materialize(held.where("lo < hi").drop("c", "lo", "hi"))
    if not held.limit(1).count():
        return None
    texts = _texts(held.select("fp").distinct(), docs, text)
    sketches = materialize(per_document(texts, ["fp"], "t", ", ".join(f"{w} long" for w in _WORDS), _make_sketch).withColumnRenamed("fp", "f"))
    discard(texts)
    columns = ["k", "fp", "size", "b0", "root", *_WORDS]
    own = held.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("size", "b0", "root")], F.collect_list(F.struct("k", "main")).alias("ks"))
    own = own.join(broadcast_if_small(sketches), F.col("fp") == F.col("f")).withColumn("of", F.explode("ks"))
    held = materialize(own.select(F.col("of.k").alias("k"), *columns[1:], F.col("of.main").alias("main")))
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"other_{w}"))) for w in _WORDS), F.lit(0))
    minor = held.where(F.col("root") != F.col("main")).select(columns)
    return _pairs(minor, held.select(columns), (F.col("root") != F.col("other_root")) & (apart <= APART))


def tally(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose fingerprints share ``SHARED`` bytes or more, by position."""
    for side in "ab":
        named = nodes.select(F.col("fp").alias(f"{side}_fp"), *[F.col(c).alias(f"{side}_{c}") for c in _BYTES])
        pairs = pairs.join(broadcast_if_small(named), F.col(side) == F.col(f"{side}_fp"))
    return pairs.where(sum((_equal_bytes(f"a_{c}", f"b_{c}") for c in _BYTES), F.lit(0)) >= SHARED).select("a", "b")


def _equal_bytes(one: str, other: str) -> Column:
    """How many of eight bytes are equal."""
    apart = F.col(one).bitwiseXOR(F.col(other))
    for shift in (4, 2, 1):  # the lowest bit of each byte becomes one if any of its bits is
        apart = apart.bitwiseOR(F.shiftrightunsigned(apart, shift))
    return 8 - F.bit_count(apart.bitwiseAND(F.lit(0x0101010101010101)))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            known: dict[int, set[int]] = {}
            sets = []
            for i in (0, 1):
                for node, t in zip(part.column(i).to_pylist(), texts_of(part.column(i + 2))):
                    if node not in known:
                        known[node] = shingles(t)
                    sets.append(known[node])
            keep = []
            for x, y in zip(sets[: part.num_rows], sets[part.num_rows :]):
                both = len(x & y)
                keep.append(LIKE[1] * both >= LIKE[0] * (len(x) + len(y) - both))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _texts(need: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(fp, t): the texts of the distinct hashes ``need``."""
    named = docs.select(_node(text).alias("fp"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    found = named.join(broadcast_if_small(materialize(need)), "fp")
    return materialize(found.groupBy("fp").agg(F.first("t").alias("t")))


def _verified(met: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs that pass the tally and whose texts are near copies."""
    met = materialize(met)
    pairs = materialize(tally(met, nodes))
    discard(met)
    texts = _texts(pairs.select("a").union(pairs.select("b")).distinct().toDF("fp"), docs, text)
    small = broadcast_if_small(texts, size=16 << 20)
    found = pairs.join(small.toDF("b", "tb"), "b").join(small.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    found = materialize(found.mapInArrow(_verify, "a long, b long"))
    discard(texts)
    return found


def link(docs: DataFrame, marked: DataFrame, text: str) -> DataFrame:
    """Links (a, b) over hashes of texts that connect all near copies that share a list."""
    nodes = materialize(marked.select("fp", "size", *_BYTES).dropDuplicates(["fp"]))
    members = busy(_members(nodes))
    links = _verified(candidates(members), nodes, docs, text)
    rest = unconnected(members, links, docs, text)
    return links if rest is None else links.unionByName(_verified(rest, nodes, docs, text))
