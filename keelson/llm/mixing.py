"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a hashed order, served again from the
start when its target asks for more than it holds. The virtual finish time of an
entry is the number of its source's words served up to its end, divided by the
source's target; all entries are range-sorted by finish time and the stream is cut
at the total budget. An entry whose source reached its target before the entry
starts is never served, so each source ends within one document of its target.

The text is never shuffled. A document's place in the queue is a hash of its key and
text, so a repeated or null key is no hot place; rows equal in both are one group with
a count, yet each of them is an entry of its own. Sums over the queue and over the
stream are cut into a bounded number of ranges; the range in which the budget ends is
sorted again, in ranges of its own, until a task can hold it. The cut is stated once
for each source as (full rounds, last place, how many rows of that place), which every
document then tests for itself.

Targets: weights 1, 2, 3, repeating, over the sources by code point, null last,
share all words; no target exceeds three times its source, the excess being shared
again by weight. In closed form: with the sources ordered by size over weight, the
first k are capped and the rest get weight times one common level.

Defined cases: a null or empty text has no words and is taken 0 times (0 words); a
source of no words has target 0; a null source is a source of its own; if the cut falls
among rows equal in key and text, some of them are taken once more than the others; ties
of finish time go by source, null last; an empty table gives an empty table; a very long
text counts with all its words; other columns travel inside a struct, so their names
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm import common
from keelson.llm.common import WORD, ahead, broadcast_if_small, materialize, ranges_of, table

ROUNDS = 3
SEED = "mix-2026:"
#: Rows of one group that a task lays out as entries.
RUN_ROWS = 1_000


def _place(key: Column, text: Column) -> Column:
    """A 60-bit place in the queue, from key and text."""
    body = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), body).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target from the words of each source (one row each)."""
    last = F.col("source").asc_nulls_last()
    ranked = ahead(sizes, [last], {"rank": F.lit(1)}).withColumn("weight", F.col("rank") % 3 + 1)
    order = [(F.col("source_size") / F.col("weight")).asc(), last]
    ranked = ahead(ranked.drop("rank"), order, {"size_before": F.col("source_size"), "weight_before": F.col("weight"), "rank": F.lit(1)})
    ranked = materialize(ranked)
    every = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left = F.lit(every["size"]) - ROUNDS * F.col("size_before")
    level = left.cast("double") / (F.lit(every["weight"]) - F.col("weight_before")).cast("double")
    most = (ROUNDS * F.col("source_size")).cast("double")
    # The first source that its level leaves below the cap sets the level of all after it.
    first = ranked.withColumn("level", level).where(F.col("level") * F.col("weight") <= most).agg(F.min(F.struct("rank", "level"))).first()[0]
    shared = F.when(F.col("rank") >= first.rank, F.lit(first.level) * F.col("weight")).otherwise(most) if first else most
    return ranked.select("source", "source_size", shared.alias("target"))


def _entries(queue: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, place, size, n, round, nth, finish) of every row's every service that starts before its target.

    ``n`` is the number of rows of the place, ``nth`` counts them from 0.
    """
    last = F.col("source").asc_nulls_last()
    queue = ahead(queue, [last, "place", "size"], {"before": F.col("size") * F.col("n")})
    offsets = ahead(goals, [last], {"offset": F.col("source_size")}).withColumnRenamed("source", "s")
    served = queue.join(broadcast_if_small(materialize(offsets)), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    served = served.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))))
    start = F.col("round") * F.col("source_size") + F.col("before") - F.col("offset")
    served = served.withColumn("start", start).where(F.col("start") < F.col("target"))
    # one more than the quotient says, as it is rounded; the filter below is exact
    rows = F.least(F.col("n"), F.ceil((F.col("target") - F.col("start")) / F.col("size")) + 1).cast("long")
    served = materialize(served.withColumn("rows", rows).select("source", "place", "size", "n", "round", "start", "rows", "target"))
    few = served.where(F.col("rows") <= RUN_ROWS)
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("nth")
    columns = ["source", "place", "size", "n", "round", "start", "target"]
    entries = few.select(*columns, nth)
    many = served.where(F.col("rows") > RUN_ROWS)
    if (most := many.agg(F.sum("rows")).first()[0]) is not None:
        # a large group is dealt to many tasks in runs before its rows are laid out
        runs = many.select(*columns, "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(RUN_ROWS).cast("long"))).alias("run"))
        runs = runs.repartition(ranges_of(most), "place", "round", "run")
        upto = F.least(F.col("rows"), F.col("run") + RUN_ROWS) - 1
        entries = entries.unionByName(runs.select(*columns, F.explode(F.sequence("run", upto)).alias("nth")))
    entries = entries.where(F.col("start") + F.col("nth") * F.col("size") < F.col("target"))
    finish = (F.col("start") + (F.col("nth") + 1) * F.col("size")).cast("double") / F.col("target")
    return entries.select("source", "place", "size", "n", "round", "nth", finish.alias("finish"))


def _cuts(entries: DataFrame, budget: int) -> DataFrame:
    """For each source served at all: its last service within the budget."""
    order = ["finish", F.col("source").asc_nulls_last(), "place", "size", "round", "nth"]
    at = F.struct("round", "place", "size", "nth", "n")
    taken = None

    def add(more: DataFrame) -> None:
        nonlocal taken
        more = more.groupBy("source").agg(F.max(at).alias("last"))
        taken = more if taken is None else taken.unionByName(more)

    while True:
        rows = entries.count()
        ranges = ranges_of(rows)
        # The global range sort; the number of the range is kept with the rows.
        entries = entries.drop("range").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        entries = materialize(entries.withColumn("range", F.spark_partition_id()))
        totals = entries.groupBy("range").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        ends = totals.withColumn("end", F.sum("words").over(Window.orderBy("range")))  # one row for each range
        crossed = ends.where(F.col("end") > budget).orderBy("range").first()
        if crossed is None:
            add(entries)
            break
        add(entries.where(F.col("range") < crossed["range"]))
        here = entries.where(F.col("range") == crossed["range"])
        budget -= crossed["end"] - crossed["words"]
        if crossed["rows"] <= common.RANGE_ROWS or crossed["rows"] == rows:
            # a range of bounded size, sorted once more with its running sum
            running = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            add(here.withColumn("end", running).where(F.col("end") <= budget))
            break
        entries = here
    return taken.groupBy("source").agg(F.max("last").alias("last"))


def _mixed(docs: DataFrame, keep: list[str], key: str, source: str, text: str) -> DataFrame:
    """row (a struct of ``keep``), size, source_size, target and copies of every document."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    slim = [F.col(f"`{source}`").alias("source"), _place(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("place"), size.alias("size")]
    queue = materialize(docs.select(*slim).groupBy("source", "place", "size").agg(F.count("*").alias("n")))
    sizes = queue.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = materialize(targets(sizes))
    budget = goals.agg(F.round(F.sum("target")).cast("long")).first()[0] or 0
    cuts = _cuts(_entries(queue.where(F.col("size") > 0), goals), budget)
    plan = goals.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    plan = materialize(plan.select(F.col("source").alias("s"), "source_size", "target", "last"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *slim)
    rows = rows.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("s")))
    here, last = F.struct("place", "size"), F.struct("last.place", "last.size")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.coalesce(F.col("last.round") + (here <= last).cast("int"), F.lit(0)))
    rows = rows.withColumn("copies", copies.cast("int"))
    columns = ["row", "size", "source_size", "target", "copies"]
    split = F.coalesce((F.col("last.nth") + 1 < F.col("last.n")) & (here == last), F.lit(False))
    if not plan.where(F.col("last.nth") + 1 < F.col("last.n")).limit(1).count():
        return rows.select(*columns)
    # The cut falls among equal rows: they are numbered by where they were written, task by task.
    some = materialize(rows.where(split).withColumn("uid", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    parts = some.groupBy(F.col("source").alias("o"), F.col("part").alias("q")).count()
    upto = Window.partitionBy("o").orderBy("q")  # one row for each task
    parts = parts.select("o", "q", (F.sum("count").over(upto) - F.col("count")).alias("first"))
    some = some.join(broadcast_if_small(parts), F.col("source").eqNullSafe(F.col("o")) & (F.col("part") == F.col("q")))
    nth = F.col("first") + F.row_number().over(Window.partitionBy("source", "part").orderBy("uid")) - 1
    some = some.withColumn("nth", nth).withColumn("copies", F.col("copies") - (F.col("nth") > F.col("last.nth")).cast("int"))
    return rows.where(~split).select(*columns).unionByName(some.select(*columns))


def mix(docs: DataFrame, keep: list[str], key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The columns ``keep`` of every document, then size, source_size, target, taken and copies."""
    mixed = _mixed(docs, keep, key, source, text)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select(*[F.col("row").getField(c).alias(c) for c in keep], "size", "source_size", "target", taken, "copies")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, ["doc_id"]).drop("copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often as it is taken."""
    names = docs.columns
    mixed = _mixed(docs, names, "doc_id", "source", "text").where(F.col("copies") > 0)
    again = mixed.select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return again.select(*[F.col("row").getField(c).alias(c) for c in names])


ORACLE_SQL = rf"""
with docs as (
  select row_number() over () as rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    ('0x' || substr(md5('{SEED}' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as place
  from documents),
sizes as (select source, sum(size)::bigint as source_size from docs group by 1),
weighted as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from sizes),
levels as (
  select *, (sum(source_size) over () - {ROUNDS} * coalesce(sum(source_size) over before, 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
  from weighted window before as (order by source_size / weight::double, source nulls last rows between unbounded preceding and 1 preceding)),
settled as (
  select *, first_value(case when level * weight <= {ROUNDS} * source_size then level end ignore nulls)
    over (order by source_size / weight::double, source nulls last rows between unbounded preceding and current row) as common
  from levels),
goals as (select source, source_size, coalesce(common * weight, ({ROUNDS} * source_size)::double) as target from settled),
served as (
  select *, sum(size) over (partition by source order by place, size, rid rows between unbounded preceding and current row) as cum
  from docs where size > 0),
entries as (
  select s.rid, s.source, place, size, round, (round * source_size + cum)::double / target as finish
  from served s join goals g on s.source is not distinct from g.source, range({ROUNDS}) r(round)
  where round * source_size + cum - size < target),
stream as (
  select *, sum(size) over (order by finish, source nulls last, place, size, round, rid rows between unbounded preceding and current row) as upto
  from entries),
taken as (
  select rid, count(*) as copies from stream where upto <= (select round(sum(target))::bigint from goals) group by 1)
select doc_id, size, source_size, target, size * coalesce(copies, 0) as taken
from docs d join goals g on d.source is not distinct from g.source left join taken t using (rid)
"""
