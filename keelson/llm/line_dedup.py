"""Line dedup by winnowing over line hashes.

From every line that has words starts a gram: the lines from there on until at least
``GRAM_WORDS`` words are covered (a long line is a gram by itself). Of the grams that
start within ``WINDOW_WORDS`` words from a line on, the one of smallest hash is a
fingerprint. So every run of whole lines with ``GRAM_WORDS + WINDOW_WORDS`` = 50 words
or more that occurs twice has a fingerprint at equal places in both, whatever stands
around it. Positions are joined on the fingerprint and, to extend the match both ways,
on the fingerprint together with its nearest 1, 2, 3 ... lines before or after, each
time with the first position of that key only. This is linear in the number of
positions, yet finds the longest extension that any earlier copy shares. The later
copy of the extended run is deleted. First means smallest document key, then place in
the text, so every deleted line has an equal line that stays. Lines are looked at as
far from a fingerprint as the next one can be, so runs of any length go whole.

All of it is DataFrame operations. Texts are not shuffled unless so many of them lose
lines that their list cannot be broadcast.

Defined cases: a null text stays null and has no lines; blank lines are never part of
a gram and go only inside a deleted run; a run may repeat within one document; rows
equal in key and text count as one document and get the same result; a null key comes
before all others; of equal minima of a window, and of equal earlier runs, the one that
comes first counts; a text of any length is looked at whole, line by line; an empty table
gives an empty table; other columns pass through in a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import WORD, broadcast_if_small, materialize, table

GRAM_WORDS = 25
WINDOW_WORDS = 25
#: Beyond the end of a gram the next fingerprint of a run starts within so many words.
AFTER_WORDS = GRAM_WORDS + WINDOW_WORDS
#: First positions that may be broadcast once they have been counted.
FIRSTS_ROWS = 200_000

_DOC = ("key", "k1", "k2")


def _identified(docs: DataFrame, key: str, text: str) -> list[Column]:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [
        F.col(f"`{key}`").alias("key"),
        F.xxhash64(F.col(f"`{key}`"), body).alias("k1"),
        F.crc32(body.cast("binary")).alias("k2"),
    ]


def _distinct(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, k1, k2 and text of each distinct document.

    Repeated ones are found by their hashes alone, so that neither texts nor the lines
    of a text that occurs many times meet in one task.
    """
    rows = docs.select(*_identified(docs, key, text), F.col(f"`{text}`").alias("text"))
    repeated = materialize(rows.groupBy(*_DOC).count().where("count > 1").select(F.col("k1").alias("r1"), F.col("k2").alias("r2")))
    if not repeated.limit(1).count():
        return rows
    repeated = broadcast_if_small(repeated)
    same = (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))
    one = rows.join(repeated, same, "left_semi").groupBy(*_DOC).agg(F.first("text").alias("text"))
    return rows.join(repeated, same, "left_anti").unionByName(one)


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprints: gram hash, place, extent and the lines around, of each distinct document."""
    lines = _distinct(docs, key, text).select(*_DOC, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select(*_DOC, "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).alias("words"))
    # One shuffle, by document; what follows keeps that partitioning.
    lines = lines.where("words > 0").repartition(*_DOC)
    doc = Window.partitionBy(*_DOC)
    running = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("upto", F.sum("words").over(running)).withColumn("s", F.col("upto") - F.col("words"))
    lines = lines.withColumn("total", F.max("upto").over(doc))
    by_word = doc.orderBy("s")
    line = F.struct("h", "pos", "s", "upto")
    ahead = F.collect_list(line).over(doc.orderBy("pos").rowsBetween(0, GRAM_WORDS + AFTER_WORDS - 1))
    behind = F.collect_list(line).over(by_word.rangeBetween(-WINDOW_WORDS, -1))
    lines = lines.select(*_DOC, "pos", "s", (F.col("s") + GRAM_WORDS <= F.col("total")).alias("whole"), ahead.alias("ahead"), behind.alias("behind"))
    lines = lines.withColumn("lines", F.filter("ahead", lambda x: x["s"] < F.col("s") + GRAM_WORDS))
    lines = lines.withColumn("gram", F.when(F.col("whole"), F.xxhash64(F.transform("lines", lambda x: x["h"]))))
    least = F.min(F.when(F.col("whole"), F.struct("gram", "pos"))).over(by_word.rangeBetween(0, WINDOW_WORDS - 1))
    lines = lines.withColumn("least", least["pos"])
    # A line is a fingerprint if it is the minimum of a window that starts at most so far before it.
    chosen = F.array_contains(F.collect_set("least").over(by_word.rangeBetween(-(WINDOW_WORDS - 1), 0)), F.col("pos"))
    last = F.element_at("lines", -1)
    slim = lambda x: F.struct(x["h"].alias("h"), x["pos"].alias("pos"))
    after = F.filter("ahead", lambda x: (x["s"] >= last["upto"]) & (x["s"] < last["upto"] + AFTER_WORDS))
    return (
        lines.withColumn("chosen", chosen)
        .where(F.col("chosen") & F.col("whole"))
        .select(
            *_DOC,
            "gram",
            "pos",
            last["pos"].alias("end"),
            F.transform(F.reverse("behind"), slim).alias("before"),
            F.transform(after, slim).alias("after"),
        )
    )


def _around(side: int, lines: str) -> Column:
    """For each number of lines next to the gram: the side, a hash of them and the place of the farthest."""
    return F.transform(
        lines,
        lambda x, i: F.struct(
            F.lit(side).alias("side"),
            F.xxhash64(F.transform(F.slice(F.col(lines), F.lit(1), i + 1), lambda y: y["h"])).alias("near"),
            x["pos"].alias("reach"),
        ),
    )


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, k1, k2, first, last): disjoint line ranges to delete, by document."""
    marks = materialize(fingerprints(docs, key, text))
    twice = materialize(marks.groupBy("gram").count().where("count > 1").select(F.col("gram").alias("g")))
    itself = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("near"), F.col("pos").alias("reach")))
    keys = F.concat(itself, _around(1, "before"), _around(2, "after"))
    found = marks.join(broadcast_if_small(twice), F.col("gram") == F.col("g")).select(*_DOC, "gram", "pos", "end", F.explode(keys).alias("k"))
    found = materialize(found.select(*_DOC, "gram", "pos", "end", "k.*"))
    by = ["gram", "side", "near"]
    place = F.struct(*[F.col(c) for c in (*_DOC, "pos")])
    firsts = found.groupBy(*by).agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that neither join depends on the partitioning of an aggregate and hot keys can be split.
    firsts = broadcast_if_small(materialize(firsts), FIRSTS_ROWS)
    met = found.join(firsts, by).where(place != F.col("place"))
    runs = met.groupBy(*_DOC, "pos", "end").agg(F.min("reach").alias("low"), F.max("reach").alias("high"))
    runs = runs.select(*_DOC, F.least("pos", "low").alias("first"), F.greatest("end", "high").alias("last"))
    # Merge overlapping and touching ranges of a document.
    order = Window.partitionBy(*_DOC).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(1)))
    runs = runs.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*_DOC, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def dedup(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep``, then n_lines, removed_lines, removed (line ranges) and clean_text of every row."""
    runs = repeated_runs(docs, key, text)
    cuts = runs.groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cuts")
    )
    cuts = materialize(cuts)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"), *_identified(docs, key, text)
    )
    rows = rows.join(broadcast_if_small(cuts, 200_000), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    lines = F.split("text", "\n", -1)
    rows = rows.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<first:int,last:int>>")))
    # What stays are the slices between the ranges.
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["last"] + 1))
    ends = F.concat(F.transform("cuts", lambda c: c["first"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))
    removed = F.aggregate("cuts", F.lit(0), lambda acc, c: acc + c["last"] - c["first"] + 1)
    listing = F.array_join(F.transform("cuts", lambda c: F.concat_ws("-", c["first"], c["last"])), ",")
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        removed.cast("long").alias("removed_lines"),
        listing.alias("removed"),
        F.when(F.size("cuts") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
