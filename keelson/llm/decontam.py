"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Items are short texts, the corpus is large, so the corpus is read once and never
shuffled. Every n-gram of an item is a seed, so any copied run of GRAM = 3 words is
seeded, however often the item occurs elsewhere. An item of which a document has too few
words to reach the accepted score is dropped first; for the others the region of the
document around each seed is aligned with the item by words, and scores its local
alignment (match 2, mismatch -1, gap -1) as a share of the most the item can reach.

Items are processed in blocks of a bounded number of words, each block being sent to
all tasks; a block's size, not the number of items, bounds what is broadcast. The corpus
is read once for each block.

Of an item of more than ``ITEM_WORDS`` words that many aligned ones count as the whole, so
``MIN_SHARE`` of them, some two sentences, are a leak however long the item is.

Defined cases: a null or empty text contains nothing, and an item without words is in no
text; an item of fewer than ``GRAM`` words is held by a text that consists of its words
alone; equal items each report their hits; of equal scores in a text the first place
counts; repeated documents each report theirs, a null key being a key; a text of any
length is searched whole; an item longer than a block is a block of its own; kept columns
travel inside a struct, so their names cannot clash; empty tables give an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import discard, materialize, per_document, table

GRAM = 3
MATCH, MISMATCH, GAP = 2, 1, 1
#: A document holds an item if the alignment reaches this share of the item's best score ...
MIN_SHARE = 0.5
#: ... where a longer item counts as one of so many words.
ITEM_WORDS = 60
#: Words of a region before and after the item's own extent, as a share of its length.
SLACK = 0.25
BLOCK_WORDS = 1_000_000

_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two sequences of word numbers, and where in ``region`` it ends."""
    n = len(region)
    ramp = GAP * np.arange(n + 1)
    above = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(region == word, MATCH, -MISMATCH), above[1:] - GAP)
        np.maximum(row, 0, out=row)
        # gaps along the row, at once: the best start to the left less its distance
        row = np.maximum.accumulate(row + ramp) - ramp
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
        above = row
    return best, end


class Block:
    """Items of one block as word numbers, and their n-grams as 64-bit codes."""

    def __init__(self, items: list[tuple[object, str]]):
        self.keys = [k for k, _ in items]
        numbers: dict[str, int] = {}
        self.items = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int64) for _, t in items]
        self.numbers, self.base = numbers, len(numbers) + 1
        self.short: dict[tuple, list[int]] = {}
        for i, x in enumerate(self.items):
            if 0 < len(x) < GRAM:
                self.short.setdefault(tuple(x.tolist()), []).append(i)
        codes = [self.codes(x) for x in self.items]
        self.grams = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)]))
        # seeds: under each n-gram, the items and places that hold it
        gram = np.searchsorted(self.grams, np.concatenate([*codes, np.zeros(0, np.int64)]))
        order = np.argsort(gram, kind="stable")
        sizes = [len(c) for c in codes]
        self.seed_item = np.repeat(np.arange(len(codes)), sizes)[order]
        self.seed_place = np.concatenate([*map(np.arange, sizes), np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.first = np.searchsorted(gram[order], np.arange(len(self.grams) + 1))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes of the n-grams of ``x``; -1 where a word is in no item."""
        if len(x) < GRAM:
            return np.zeros(0, np.int64)
        out, known = np.zeros(len(x) - GRAM + 1, np.int64), np.ones(len(x) - GRAM + 1, bool)
        for j in range(GRAM):
            part = x[j : len(x) - GRAM + 1 + j]
            out = out * self.base + part
            known &= part >= 0
        return np.where(known, out, -1)

    def occurrences(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The document as word numbers, and where in it which n-grams of items stand."""
        get = self.numbers.get
        x = np.array([get(w, -1) for w in words_of(text.decode("utf-8", "replace"))], np.int64)
        codes = self.codes(x)
        at = np.flatnonzero(codes >= 0)
        if not at.size or not self.grams.size:
            return x, at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.grams, codes[at]), len(self.grams) - 1)
        found = self.grams[place] == codes[at]
        return x, at[found], place[found]

    def hits(self, text: bytes) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, last word) of each item that the text holds, at its best place."""
        x, at, grams = self.occurrences(text)
        if len(x) < GRAM:
            return [(i, 1.0, 0, len(x) - 1) for i in self.short.get(tuple(x.tolist()), ())]
        if not at.size:
            return []
        n = self.first[grams + 1] - self.first[grams]
        seed = np.repeat(self.first[grams] - np.cumsum(n) + n, n) + np.arange(n.sum())
        # no alignment matches more words of an item than the document has
        present = np.zeros(len(self.numbers), bool)
        present[x[x >= 0]] = True
        able = np.zeros(len(self.items), bool)
        for i in np.unique(self.seed_item[seed]).tolist():
            item = self.items[i]
            able[i] = np.count_nonzero(present[item]) >= MIN_SHARE * min(len(item), ITEM_WORDS)
        keep = able[self.seed_item[seed]]
        starts = (np.repeat(at, n) - self.seed_place[seed])[keep]
        regions: dict[int, list[list[int]]] = {}
        for i, p in sorted(set(zip(self.seed_item[seed][keep].tolist(), starts.tolist()))):
            size = len(self.items[i])
            slack = 2 + int(SLACK * size)
            lo, hi = max(0, p - slack), min(len(x), p + size + slack)
            spans = regions.setdefault(i, [])
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        out = []
        for i, spans in regions.items():
            item = self.items[i]
            most = MATCH * min(len(item), ITEM_WORDS)
            own, best = Counter(item.tolist()), (0.0, 0, 0)
            for lo, hi in spans:
                region = x[lo:hi]
                # no alignment matches more words than both sides have in common
                common = sum(min(n, own[w]) for w, n in Counter(region[region >= 0].tolist()).items() if w in own)
                if MATCH * common < MIN_SHARE * most or MATCH * common <= best[0] * most:
                    continue
                score, end = align(item, region)
                if score / most > best[0]:
                    back, start = align(item[::-1], region[:end][::-1])
                    best = (score / most, lo + end - start, lo + end - 1)
            if best[0] >= MIN_SHARE:
                out.append((i, min(1.0, best[0]), best[1], best[2]))
        return out


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[Block]:
    held: list[tuple[object, str]] = []
    size = 0
    for row in items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        held.append((row.k, row.t or ""))
        size += 1 + len(words_of(row.t or ""))
        if size >= BLOCK_WORDS:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def find(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc, item, score, first_word, last_word) for every document and item that it holds."""
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType.simpleString()
    found = None
    for block in _blocks(items, item_key, item_text):
        chosen = docs.sparkSession.sparkContext.broadcast(block)

        def search(chosen=chosen):
            def work(texts):
                rows = [chosen.value.hits(t) for t in texts]
                return {"hits": [[dict(zip(("i", "score", "first_word", "last_word"), h)) for h in r] for r in rows]}

            return work

        schema = "hits array<struct<i:int,score:double,first_word:int,last_word:int>>"
        hits = per_document(docs, [key], text, schema, search).toDF("doc", "hits").select("doc", F.explode("hits").alias("h"))
        # a block's items, so no more than BLOCK_WORDS rows
        names = spark.createDataFrame(list(enumerate(block.keys)), f"i int, item {kind}")
        part = hits.select("doc", "h.*").join(F.broadcast(names), "i")
        part = materialize(part.select("doc", "item", "score", "first_word", "last_word"))
        chosen.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        doc_kind = docs.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"doc {doc_kind}, item {kind}, score double, first_word int, last_word int")
    return found


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item; each row is judged by itself, without a join."""
    names, sent, source, read = docs.columns, None, docs, docs
    for block in _blocks(items, item_key, item_text):
        if sent:  # what the last block left is written, so no block is searched for twice
            docs = materialize(docs)
            sent.destroy()
            if read is not source:
                discard(read)
        read, sent = docs, docs.sparkSession.sparkContext.broadcast(block)

        def search(chosen=sent):
            return lambda texts: {"held": [bool(chosen.value.hits(t)) for t in texts]}

        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
        judged = per_document(whole, ["row"], "text", "held boolean", search).where(~F.col("held"))
        docs = judged.select(*[F.col("row").getField(c).alias(c) for c in names])
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, table(spark, sf_dir, "benchmark")).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
