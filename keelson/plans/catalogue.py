"""Registered queries over projections, each with the SQL that says the same.

The projections a query needs are built on first use, one folder for each session and
input, in the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import sketches
from keelson.functions.types import uuid_text
from keelson.operators.predicates import Param, between, eq, ge, gt, is_not_null, is_null, isin, le, lt
from keelson.operators.scan import Cursor, PreparedScan, lookup_join, scan
from keelson.operators.statistics import BROADCAST_FILES, inspect, kept_leaves, leaf_statistics, levels, upper_level
from keelson.plans.chooser import choose, query
from keelson.plans.options import ProjectionOptions
from keelson.sources import storage
from keelson.sources.projection import Projection, build_projection

#: Leaf size of the registered statistics queries.
LEAF_ROWS = 1356


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _uuid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table("events")(spark, sf_dir)
    return events.select(uuid_text(F.upper(F.md5(F.col("event_id").cast("string").cast("binary")))).alias("u"), "event_id")


#: name: source, keys, include, condition, further arguments.
PROJECTIONS: dict[str, tuple] = {
    "lineitem_supp": (
        _table("lineitem"),
        ["l_suppkey", "l_partkey"],
        ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"],
        None,
        {},
    ),
    "lineitem_order": (_table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"], None, {}),
    "lineitem_order_one": (_table("lineitem"), ["l_orderkey"], [], None, {}),
    "lineitem_wide": (
        _table("lineitem"),
        ["l_suppkey"],
        ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"],
        None,
        {"options": ProjectionOptions(leaf_rows=LEAF_ROWS)},
    ),
    "orders_key": (_table("orders"), ["o_orderkey"], ["o_custkey", "o_orderstatus"], None, {}),
    "orders_f": (_table("orders"), ["o_orderkey"], ["o_custkey", "o_orderstatus"], "o_orderstatus = 'F'", {}),
    "orders_cust": (_table("orders"), ["o_custkey"], ["o_orderkey"], None, {}),
    "orders_date": (_table("orders"), ["o_orderdate"], ["o_orderkey", "o_custkey"], None, {}),
    "orders_status": (_table("orders"), ["o_orderstatus"], ["o_orderkey", "o_orderdate"], None, {}),
    "orders_day": (
        lambda s, d: _table("orders")(s, d).select(F.col("o_orderdate").cast("date").alias("d"), "o_orderkey"),
        ["d"],
        ["o_orderkey"],
        None,
        {},
    ),
    "orders_priority": (_table("orders"), ["o_orderpriority"], ["o_orderkey"], None, {}),
    "customer_balance": (_table("customer"), ["c_acctbal"], ["c_custkey"], None, {}),
    "customer_money": (
        lambda s, d: _table("customer")(s, d).select(F.col("c_acctbal").cast("decimal(19,2)").alias("m"), "c_custkey"),
        ["m"],
        ["c_custkey"],
        None,
        {"declared": {"m": "money"}},
    ),
    "customer_name": (_table("customer"), ["c_name"], ["c_custkey"], None, {}),
    "customer_collated": (_table("customer"), ["c_name"], [], None, {"collation": "UNICODE"}),
    "orders_none": (lambda s, d: _table("orders")(s, d).where("o_orderkey < 0"), ["o_orderkey"], ["o_custkey"], None, {}),
    "part_size": (_table("part"), ["p_size"], ["p_partkey"], None, {}),
    "nation": (_table("nation"), ["n_nationkey"], ["n_name", "n_regionkey"], None, {}),
    "events_ts": (_table("events"), ["ts"], ["event_id", "user_id", "value"], None, {}),
    "events_type": (_table("events"), ["event_type", "user_id"], ["event_id"], None, {}),
    "events_user": (_table("events"), ["user_id"], ["event_type", "event_id"], None, {}),
    "events_value": (_table("events"), ["value"], ["event_id"], None, {}),
    "events_id": (_table("events"), ["event_id"], [], None, {}),
    "events_uuid": (_uuid_events, ["u"], ["event_id"], None, {"declared": {"u": "uuid"}}),
    "labels_quality": (
        lambda s, d: _table("labels")(s, d).where("quality is not null").select((F.col("quality") == 1).alias("k"), "doc_id"),
        ["k"],
        [],
        None,
        {},
    ),
}

_OPEN: dict[tuple, Projection] = {}


def projection(spark: SparkSession, sf_dir: str, name: str) -> Projection:
    """The named projection over ``sf_dir``, built on first use in this session."""
    app = spark.sparkContext.applicationId
    at = (app, sf_dir, name)
    if at not in _OPEN:
        source, keys, include, where, how = PROJECTIONS[name]
        base = f"{storage.shared_folder(spark)}/keelson-projections-{app}"
        storage.delete_at_exit(spark, base)
        path = f"{base}/{zlib.crc32(sf_dir.encode()):08x}/{name}"
        if storage.exists(spark, path):  # left by a build that was interrupted
            storage.delete(spark, path)
        _OPEN[at] = build_projection(source(spark, sf_dir), path, keys, include, where, **how)
    return _OPEN[at]


class Context:
    """A session and an input folder, as the query functions see them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> Projection:
        return projection(self.spark, self.sf_dir, name)

    def scan(self, name: str, *preds, **how) -> DataFrame:
        return scan(self[name], *preds, **how)

    def table(self, name: str) -> DataFrame:
        return _table(name)(self.spark, self.sf_dir)




def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


_LINE = ["l_orderkey", "l_linenumber", "l_suppkey"]
_SUPP = ["l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"]


def _day(y: int, m: int, d: int) -> datetime:
    return datetime(y, m, d)


def _ts(column: str, low: str, high: str):
    """A half-open time range, as a condition on a projection's own key."""
    return [ge(column, datetime.fromisoformat(low)), lt(column, datetime.fromisoformat(high))]


def _line_runs(c: Context) -> DataFrame:
    p = c["lineitem_wide"]
    files = sorted(p.files, key=lambda f: f.ordinal)
    # a run that goes on in the next file was counted in both
    twice = sum(a.high == b.low for a, b in zip(files, files[1:]))
    leaves = leaf_statistics(p, 1 << 30)
    return leaves.agg(F.sum("n").alias("items"), (F.sum("runs") - twice).alias("runs"))


def _leaves(c: Context) -> DataFrame:
    return leaf_statistics(c["lineitem_order"], LEAF_ROWS, across_files=True)


def _no_false_negative(c: Context) -> DataFrame:
    p = c["lineitem_wide"]
    leaves = p.leaves().select("leaf", "file", "bloom")
    first = leaves.groupBy("file").agg(F.min("leaf").alias("first"))
    rows = p.data().select("l_suppkey", F.col("_metadata.file_name").alias("file"), F.floor(F.col("_metadata.row_index") / LEAF_ROWS).alias("part"))
    rows = rows.join(F.broadcast(first) if len(p.files) <= BROADCAST_FILES else first, "file").withColumn("leaf", F.col("first") + F.col("part")).drop("file")
    missed = rows.join(leaves.select("leaf", "bloom"), "leaf").where(~sketches.might_contain(F.col("bloom"), F.col("l_suppkey"), p.options.bloom_nhash))
    return missed.agg(_n())


def _chosen(c: Context) -> DataFrame:
    """Which projection answers some queries; an empty name stands for the base table."""
    names = ["lineitem_supp", "lineitem_order", "lineitem_wide"]
    known = {c[n].path: n for n in names}
    asked = [
        ("by_supplier", ["l_suppkey", "l_orderkey"], [eq("l_suppkey", 42)]),
        ("by_order", ["l_orderkey", "l_partkey"], [eq("l_orderkey", 100)]),
        ("uncovered", ["l_shipdate"], [eq("l_orderkey", 100)]),
    ]
    rows = []
    for label, columns, preds in asked:
        p = choose([c[n] for n in names], columns, *preds).projection
        rows.append((label, known[p.path] if p else ""))
    return c.spark.createDataFrame(rows, "query string, projection string")


def _upper(c: Context) -> DataFrame:
    return upper_level(_leaves(c).withColumn("bloom", F.lit(0).cast("long")), 8).select("leaf", "mn", "mx", "n")


_LEAF_SQL = f"""with s as (select l_orderkey k, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) r from lineitem),
leaves as (select cast(floor((r - 1) / {LEAF_ROWS}) as bigint) leaf, min(k) mn, max(k) mx, count(*) n, least(count(distinct k), 65535) d from s group by 1)"""
_SUPP_SQL = "select l_suppkey, l_partkey, l_orderkey, l_linenumber from lineitem where"
_LINE_SQL = "select l_orderkey, l_linenumber, l_suppkey from lineitem"
_UUID_SQL = """(select concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) u, event_id
from (select md5(cast(event_id as varchar)) h, event_id from events))"""


def _fifty(step: int, n: int) -> list[int]:
    return [step * i for i in range(1, n + 1)]


def _scans() -> dict[str, tuple[Callable[[Context], DataFrame], str]]:
    order, supp = "lineitem_order", "lineitem_supp"
    return {
        "scan_full_forward": (lambda c: c.scan(order, columns=_LINE, order="asc", then=["l_partkey", "l_suppkey"]), _LINE_SQL),
        "scan_ge": (lambda c: c.scan(order, ge("l_orderkey", 14000), columns=_LINE), f"{_LINE_SQL} where l_orderkey >= 14000"),
        "scan_gt": (lambda c: c.scan(order, gt("l_orderkey", 14000), columns=_LINE), f"{_LINE_SQL} where l_orderkey > 14000"),
        "scan_le": (lambda c: c.scan(order, le("l_orderkey", 1000), columns=_LINE), f"{_LINE_SQL} where l_orderkey <= 1000"),
        "scan_lt": (lambda c: c.scan(order, lt("l_orderkey", 1000), columns=_LINE), f"{_LINE_SQL} where l_orderkey < 1000"),
        "scan_eq_multi": (
            lambda c: c.scan(supp, eq("l_suppkey", 42), columns=["l_suppkey", "l_orderkey", "l_linenumber"]),
            "select l_suppkey, l_orderkey, l_linenumber from lineitem where l_suppkey = 42",
        ),
        "scan_eq_missing": (lambda c: c.scan(supp, eq("l_suppkey", 999999), columns=_SUPP), f"{_SUPP_SQL} l_suppkey = 999999"),
        "scan_between": (lambda c: c.scan(order, between("l_orderkey", 100, 200), columns=_LINE), f"{_LINE_SQL} where l_orderkey between 100 and 200"),
        "scan_half_open": (
            lambda c: c.scan(order, ge("l_orderkey", 100), lt("l_orderkey", 200), columns=_LINE),
            f"{_LINE_SQL} where l_orderkey >= 100 and l_orderkey < 200",
        ),
        "scan_open_open": (
            lambda c: c.scan(order, gt("l_orderkey", 100), lt("l_orderkey", 200), columns=_LINE),
            f"{_LINE_SQL} where l_orderkey > 100 and l_orderkey < 200",
        ),
        "scan_same_side_bounds": (
            lambda c: c.scan(order, gt("l_orderkey", 100), gt("l_orderkey", 150), le("l_orderkey", 180), columns=_LINE),
            f"{_LINE_SQL} where l_orderkey > 100 and l_orderkey > 150 and l_orderkey <= 180",
        ),
        "scan_contradiction": (
            lambda c: c.scan(order, gt("l_orderkey", 200), lt("l_orderkey", 100), columns=_LINE),
            f"{_LINE_SQL} where l_orderkey > 200 and l_orderkey < 100",
        ),
        "scan_negative_keys": (lambda c: c.scan("customer_balance", lt("c_acctbal", -500.0)), "select c_acctbal, c_custkey from customer where c_acctbal < -500"),
        "scan_negative_to_positive": (
            lambda c: c.scan("customer_balance", between("c_acctbal", -100.0, 100.0)),
            "select c_acctbal, c_custkey from customer where c_acctbal between -100 and 100",
        ),
        "scan_backward_topk": (
            lambda c: c.scan("events_ts", columns=["event_id", "ts"], order="desc", then=["event_id"], limit=100),
            "select event_id, ts from events order by ts desc, event_id desc limit 100",
        ),
        "scan_backward_range": (
            lambda c: c.scan(order, le("l_orderkey", 500), order="desc", then=["l_partkey", "l_suppkey"], limit=50),
            "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_orderkey <= 500 order by 1 desc, 2 desc, 3 desc, 4 desc limit 50",
        ),
        "two_key_eq_eq": (
            lambda c: c.scan(supp, eq("l_suppkey", 42), eq("l_partkey", 100), columns=_SUPP),
            f"{_SUPP_SQL} l_suppkey = 42 and l_partkey = 100",
        ),
        "two_key_eq_eq_hit": (
            lambda c: c.scan(order, eq("l_orderkey", 100), eq("l_linenumber", 1), columns=_LINE),
            f"{_LINE_SQL} where l_orderkey = 100 and l_linenumber = 1",
        ),
        "two_key_eq_range": (
            lambda c: c.scan(supp, eq("l_suppkey", 42), ge("l_partkey", 1500), columns=_SUPP),
            f"{_SUPP_SQL} l_suppkey = 42 and l_partkey >= 1500",
        ),
        "two_key_range_eq": (
            lambda c: c.scan(supp, ge("l_suppkey", 50), eq("l_partkey", 100), columns=_SUPP),
            f"{_SUPP_SQL} l_suppkey >= 50 and l_partkey = 100",
        ),
        "two_key_range_range": (
            lambda c: c.scan(supp, gt("l_suppkey", 10), lt("l_suppkey", 20), lt("l_partkey", 50), columns=_SUPP),
            f"{_SUPP_SQL} l_suppkey > 10 and l_suppkey < 20 and l_partkey < 50",
        ),
        "two_key_range_backward": (
            lambda c: c.scan(supp, gt("l_suppkey", 10), lt("l_suppkey", 20), lt("l_partkey", 50), columns=_SUPP, order="desc", then=["l_orderkey", "l_linenumber"]),
            f"{_SUPP_SQL} l_suppkey > 10 and l_suppkey < 20 and l_partkey < 50",
        ),
        "two_key_nonleading": (lambda c: c.scan(supp, eq("l_partkey", 100), columns=_SUPP), f"{_SUPP_SQL} l_partkey = 100"),
        "two_key_backward": (
            lambda c: c.scan(supp, eq("l_suppkey", 42), columns=_SUPP, order="desc", then=["l_orderkey", "l_linenumber"], limit=20),
            f"{_SUPP_SQL} l_suppkey = 42 order by 2 desc, 3 desc, 4 desc limit 20",
        ),
        "include_filter": (
            lambda c: c.scan(supp, between("l_suppkey", 10, 20), gt("l_quantity", 45.0), columns=["l_suppkey", "l_quantity"]),
            "select l_suppkey, l_quantity from lineitem where l_suppkey between 10 and 20 and l_quantity > 45",
        ),
        "in_5": (
            lambda c: c.scan("orders_key", isin("o_orderkey", *_fifty(100, 5)), columns=["o_orderkey", "o_custkey"]),
            "select o_orderkey, o_custkey from orders where o_orderkey in (100, 200, 300, 400, 500)",
        ),
        "in_50": (
            lambda c: c.scan("orders_key", isin("o_orderkey", *_fifty(37, 50)), columns=["o_orderkey", "o_custkey"]),
            f"select o_orderkey, o_custkey from orders where o_orderkey in ({', '.join(map(str, _fifty(37, 50)))})",
        ),
        "in_500": (
            lambda c: c.scan("orders_key", isin("o_orderkey", *_fifty(11, 500)), columns=["o_orderkey", "o_custkey"]),
            f"select o_orderkey, o_custkey from orders where o_orderkey in ({', '.join(map(str, _fifty(11, 500)))})",
        ),
        "in_null": (
            lambda c: c.scan("orders_key", isin("o_orderkey", 1, None, 3), columns=["o_orderkey", "o_custkey"]),
            "select o_orderkey, o_custkey from orders where o_orderkey in (1, null, 3)",
        ),
        "eq_null": (
            lambda c: c.scan("orders_key", eq("o_orderkey", None), columns=["o_orderkey", "o_custkey"]),
            "select o_orderkey, o_custkey from orders where o_orderkey = null",
        ),
        "is_null": (lambda c: c.scan("orders_key", is_null("o_orderkey")).agg(_n()), "select count(*) n from orders where o_orderkey is null"),
        "is_not_null": (lambda c: c.scan("orders_key", is_not_null("o_orderkey")).agg(_n()), "select count(*) n from orders where o_orderkey is not null"),
        "cross_type_compare": (
            lambda c: c.scan("part_size", ge("p_size", 40), columns=["p_size", "p_partkey"]),
            "select p_size, p_partkey from part where p_size >= cast(40 as bigint)",
        ),
        "prepared_scan": (
            lambda c: PreparedScan(c["orders_key"], ge("o_orderkey", Param("low")), lt("o_orderkey", Param("high")), columns=["o_orderkey", "o_custkey"]).run(low=500, high=600),
            "select o_orderkey, o_custkey from orders where o_orderkey >= 500 and o_orderkey < 600",
        ),
        "offset_fetch": (
            lambda c: c.scan("events_id", gt("event_id", 100), order="asc", limit=10, offset=20),
            "select event_id from events where event_id > 100 order by event_id limit 10 offset 20",
        ),
        "partial_projection": (
            lambda c: query(
                c.table("orders"), [c["orders_f"], c["orders_key"]], ["o_orderkey", "o_custkey"], between("o_orderkey", 1000, 5000), conditions=["o_orderstatus = 'F'"]
            ),
            "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderkey between 1000 and 5000",
        ),
        "base_table_fallback": (
            lambda c: query(c.table("lineitem"), [c["lineitem_order"]], ["l_orderkey", "l_tax"], eq("l_orderkey", 7)),
            "select l_orderkey, l_tax from lineitem where l_orderkey = 7",
        ),
    }


def _types() -> dict[str, tuple[Callable[[Context], DataFrame], str]]:
    return {
        "text_range": (
            lambda c: c.scan("customer_name", ge("c_name", "Customer#000000100"), lt("c_name", "Customer#000000200")),
            "select c_name, c_custkey from customer where c_name >= 'Customer#000000100' and c_name < 'Customer#000000200'",
        ),
        "text_eq_group": (
            lambda c: c.scan("orders_priority", ge("o_orderpriority", "2")).groupBy("o_orderpriority").agg(_n()),
            "select o_orderpriority, count(*) n from orders where o_orderpriority >= '2' group by 1",
        ),
        "text_int_two_key": (
            lambda c: c.scan("events_type", eq("event_type", "click"), between("user_id", 10, 20)),
            "select event_type, user_id, event_id from events where event_type = 'click' and user_id between 10 and 20",
        ),
        "text_int_backward": (
            lambda c: c.scan("events_type", eq("event_type", "click"), order="desc", then=["event_id"], limit=30),
            "select event_type, user_id, event_id from events where event_type = 'click' order by user_id desc, event_id desc limit 30",
        ),
        "timestamp_range": (
            lambda c: c.scan("events_ts", _ts("ts", "2024-01-10", "2024-01-12"), columns=["ts", "event_id"]),
            "select ts, event_id from events where ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-12 00:00:00'",
        ),
        "date_range": (
            lambda c: c.scan("orders_day", between("d", date(1996, 6, 1), date(1996, 6, 30))).groupBy(F.col("d").cast("string").alias("d")).agg(_n()),
            "select cast(d as varchar) d, count(*) n from (select cast(o_orderdate as date) d from orders) where d between date '1996-06-01' and date '1996-06-30' group by d",
        ),
        "bool_key": (lambda c: c.scan("labels_quality").groupBy("k").agg(_n()), "select k, count(*) n from (select quality = 1 k from labels where quality is not null) group by k"),
        "bool_eq": (lambda c: c.scan("labels_quality", eq("k", False)).agg(_n()), "select count(*) n from labels where quality <> 1"),
        "float_key": (lambda c: c.scan("events_value", gt("value", 50.5)), "select value, event_id from events where value > 50.5"),
        "uuid_range": (
            lambda c: c.scan("events_uuid", ge("u", "c0000000-0000-0000-0000-000000000000")),
            f"select u, event_id from {_UUID_SQL} where u >= 'c0000000-0000-0000-0000-000000000000'",
        ),
        "uuid_all": (lambda c: c.scan("events_uuid", ge("u", "00000000-0000-0000-0000-000000000000")).agg(_n()), "select count(*) n from events"),
        "money_sum": (
            lambda c: c.scan("customer_money", ge("m", Decimal("100.00"))).agg(
                (F.sum("m") * 100).cast("bigint").alias("cents"), _n()
            ),
            "select cast(sum(cast(c_acctbal as decimal(19,2))) * 100 as bigint) cents, count(*) n from customer where cast(c_acctbal as decimal(19,2)) >= 100.00",
        ),
        "decimal_include": (
            lambda c: c.scan("lineitem_supp", eq("l_suppkey", 7), lt("l_partkey", 200)).select(
                "l_suppkey", "l_partkey", sketches.unbounded_numeric(F.col("l_extendedprice")).cast("string").alias("p")
            ),
            "select l_suppkey, l_partkey, cast(cast(l_extendedprice as decimal(18,4)) as varchar) p from lineitem where l_suppkey = 7 and l_partkey < 200",
        ),
        "numeric_scaled_int": (
            lambda c: c.scan("lineitem_supp").where("l_orderkey <= 50").select(
                "l_orderkey", "l_linenumber", sketches.to_scaled_int(F.col("l_extendedprice").cast("decimal(18,2)"), 2).alias("cents")
            ),
            "select l_orderkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint) cents from lineitem where l_orderkey <= 50",
        ),
    }


def _aggregates() -> dict[str, tuple[Callable[[Context], DataFrame], str]]:
    supp = "lineitem_supp"
    return {
        "agg_count": (lambda c: c.scan(supp, ge("l_suppkey", 50)).agg(_n()), "select count(*) n from lineitem where l_suppkey >= 50"),
        "agg_sum": (
            lambda c: c.scan(supp, between("l_suppkey", 10, 20)).agg(F.sum("l_partkey").alias("s"), _n()),
            "select cast(sum(l_partkey) as bigint) s, count(*) n from lineitem where l_suppkey between 10 and 20",
        ),
        "agg_sums": (
            lambda c: c.scan(supp, eq("l_suppkey", 3)).agg(F.sum("l_partkey").alias("a"), F.sum("l_orderkey").alias("b"), F.sum("l_linenumber").alias("d")),
            "select cast(sum(l_partkey) as bigint) a, cast(sum(l_orderkey) as bigint) b, cast(sum(l_linenumber) as bigint) d from lineitem where l_suppkey = 3",
        ),
        "agg_min_max": (
            lambda c: c.scan(supp, eq("l_suppkey", 9)).agg(F.min("l_orderkey").alias("mn"), F.max("l_orderkey").alias("mx"), F.min("l_linenumber").alias("mn2")),
            "select min(l_orderkey) mn, max(l_orderkey) mx, min(l_linenumber) mn2 from lineitem where l_suppkey = 9",
        ),
        "agg_avg": (
            lambda c: c.scan(supp, eq("l_suppkey", 5)).agg(_n(), F.round(F.avg(F.col("l_linenumber").cast("double")), 6).alias("a")),
            "select count(*) n, round(avg(cast(l_linenumber as double)), 6) a from lineitem where l_suppkey = 5",
        ),
        "agg_count_distinct": (
            lambda c: c.scan("lineitem_order", ge("l_orderkey", 10000)).agg(F.count_distinct("l_suppkey").alias("n")),
            "select count(distinct l_suppkey) n from lineitem where l_orderkey >= 10000",
        ),
        "agg_filter": (
            lambda c: c.scan(supp, gt("l_suppkey", 50)).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), _n()),
            "select count(*) filter (where l_returnflag = 'R') r, count(*) n from lineitem where l_suppkey > 50",
        ),
        "group_key": (lambda c: c.scan(supp).groupBy("l_suppkey").agg(_n()), "select l_suppkey, count(*) n from lineitem group by 1"),
        "group_key_includes": (
            lambda c: c.scan(supp).groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(_n()),
            "select l_suppkey, l_returnflag, l_linestatus, count(*) n from lineitem group by 1, 2, 3",
        ),
        "group_include": (
            lambda c: c.scan("events_user", eq("user_id", 5)).groupBy("event_type").agg(_n()),
            "select event_type, count(*) n from events where user_id = 5 group by 1",
        ),
        "nested_loop_join": (
            lambda c: lookup_join(
                c.scan("orders_cust", le("o_custkey", 20), columns=["o_orderkey"]), c["lineitem_order"], {"o_orderkey": "l_orderkey"}, ["l_linenumber", "l_partkey"]
            ),
            "select o.o_orderkey, l.l_linenumber, l.l_partkey from orders o join lineitem l on l.l_orderkey = o.o_orderkey where o.o_custkey <= 20",
        ),
        "scalar_subquery": (
            lambda c: c.scan("customer_balance")
            .crossJoin(F.broadcast(c.scan("customer_balance").agg(F.max("c_acctbal").alias("top"))))
            .where("c_acctbal = top")
            .select("c_custkey", "c_acctbal"),
            "select c_custkey, c_acctbal from customer where c_acctbal = (select max(c_acctbal) from customer)",
        ),
        "rle_runs": (
            _line_runs,
            """with s as (select l_suppkey k, lag(l_suppkey) over (order by l_suppkey, l_orderkey, l_linenumber, l_partkey) p from lineitem)
            select count(*) items, cast(sum(case when p is null or p <> k then 1 else 0 end) as bigint) runs from s""",
        ),
        "leaf_stats": (lambda c: _leaves(c).select("leaf", "mn", "mx", "n", "d"), f"{_LEAF_SQL} select * from leaves"),
        "leaf_prune": (
            lambda c: _leaves(c).agg(_n().alias("leaves")).crossJoin(
                F.broadcast(kept_leaves(c["lineitem_order"], between("l_orderkey", 5000, 6000), leaves=_leaves(c)).agg(F.count(F.lit(1)).alias("kept")))
            ),
            f"{_LEAF_SQL} select count(*) leaves, cast(sum(case when mx >= 5000 and mn <= 6000 then 1 else 0 end) as bigint) kept from leaves",
        ),
        "upper_levels": (
            _upper,
            f"{_LEAF_SQL} select cast(floor(leaf / 8) as bigint) leaf, min(mn) mn, max(mx) mx, cast(sum(n) as bigint) n from leaves group by 1",
        ),
        "bloom_no_false_negative": (_no_false_negative, "select cast(0 as bigint) n"),
        "root_level": (
            lambda c: levels(c["lineitem_wide"])[-1].select("mn", "mx", "n"),
            "select min(l_suppkey) mn, max(l_suppkey) mx, count(*) n from lineitem",
        ),
        "chooser": (
            _chosen,
            "select * from (values ('by_supplier', 'lineitem_wide'), ('by_order', 'lineitem_order'), ('uncovered', '')) t(query, projection)",
        ),
        "collated_order": (
            lambda c: c.scan("customer_collated", order="asc", limit=50).select(F.col("c_name").cast("string").alias("c_name")),
            "select c_name from customer order by lower(c_name), c_name limit 50",
        ),
        "cursor_pages": (_pages, "select o_orderkey, o_custkey from (select o_orderkey, o_custkey, row_number() over (order by o_orderkey) r from orders) where r between 8 and 17"),
        "empty_projection": (lambda c: c.scan("orders_none"), "select o_orderkey, o_custkey from orders where o_orderkey < 0"),
        "view_sql": (_by_view, "select o_orderstatus, count(*) n from orders where o_orderkey between 500 and 5000 group by 1"),
        "inspect_rows": (lambda c: inspect(c["lineitem_wide"]).select("rows"), "select count(*) as rows from lineitem"),
    }


def _pages(c: Context) -> DataFrame:
    """Ten rows of a cursor that went forward, back and forward again."""
    cursor = Cursor(c["orders_key"], columns=["o_orderkey", "o_custkey"])
    cursor.forward(12)
    cursor.backward(4)
    cursor.move(-1)
    return c.spark.createDataFrame(cursor.forward(10), "o_orderkey long, o_custkey long")


def _by_view(c: Context) -> DataFrame:
    c["orders_key"].view("keelson_orders_key")
    return c.spark.sql("select o_orderstatus, count(*) n from keelson_orders_key where o_orderkey between 500 and 5000 group by 1")


def _share_from(p: Projection, part: int) -> int:
    """The key from which on about one of ``part`` keys lies, by the highest key of the manifest."""
    high = max(f.high for f in p.files)
    return high - high // part


def _workloads() -> dict[str, tuple[Callable[[Context], DataFrame], str]]:
    """The shapes of the benchmark, on the tables that play the same roles."""
    wide, key = "lineitem_wide", "orders_key"
    return {
        "hot_metric": (
            lambda c: c.scan(wide, eq("l_suppkey", 1)).agg(_n(), F.round(F.avg("l_quantity"), 6).alias("a")),
            "select count(*) n, round(avg(l_quantity), 6) a from lineitem where l_suppkey = 1",
        ),
        "metric_range": (
            lambda c: c.scan(wide, between("l_suppkey", 1, 10)).agg(_n(), F.round(F.avg("l_quantity"), 6).alias("a")),
            "select count(*) n, round(avg(l_quantity), 6) a from lineitem where l_suppkey between 1 and 10",
        ),
        "recent_orders": (
            lambda c: c.scan("orders_date", ge("o_orderdate", _day(1998, 1, 1))).agg(_n()),
            "select count(*) n from orders where o_orderdate >= timestamp '1998-01-01'",
        ),
        "single_day": (
            lambda c: c.scan("orders_day", eq("d", date(1996, 6, 15))).agg(_n()),
            "select count(*) n from orders where cast(o_orderdate as date) = date '1996-06-15'",
        ),
        "hot_user_group": (
            lambda c: c.scan("events_user", eq("user_id", 1)).groupBy("event_type").agg(_n()),
            "select event_type, count(*) n from events where user_id = 1 group by 1",
        ),
        "user_range": (lambda c: c.scan("events_user", between("user_id", 10, 50)).agg(_n()), "select count(*) n from events where user_id between 10 and 50"),
        "status_eq": (lambda c: c.scan("orders_status", eq("o_orderstatus", "P")).agg(_n()), "select count(*) n from orders where o_orderstatus = 'P'"),
        "status_in": (lambda c: c.scan("orders_status", isin("o_orderstatus", "P", "O")).agg(_n()), "select count(*) n from orders where o_orderstatus in ('P', 'O')"),
        "point_lookup": (lambda c: c.scan("nation", eq("n_nationkey", 7)), "select n_nationkey, n_name, n_regionkey from nation where n_nationkey = 7"),
        "half_range": (lambda c: c.scan("nation", ge("n_nationkey", 12)).agg(_n()), "select count(*) n from nation where n_nationkey >= 12"),
        "sel_0_1_percent": (
            lambda c: c.scan(key, ge("o_orderkey", _share_from(c[key], 1000))).agg(_n()),
            "select count(*) n from orders where o_orderkey >= (select max(o_orderkey) - max(o_orderkey) // 1000 from orders)",
        ),
        "sel_10_percent": (
            lambda c: c.scan(key, ge("o_orderkey", _share_from(c[key], 10))).agg(_n()),
            "select count(*) n from orders where o_orderkey >= (select max(o_orderkey) - max(o_orderkey) // 10 from orders)",
        ),
        "include_0": (lambda c: c.scan("lineitem_order_one", ge("l_orderkey", 5000)).agg(_n()), "select count(*) n from lineitem where l_orderkey >= 5000"),
        "include_4": (
            lambda c: c.scan(wide, ge("l_suppkey", 50)).agg(_n(), F.sum("l_orderkey").alias("a"), F.sum("l_partkey").alias("b"), F.sum("l_linenumber").alias("d")),
            "select count(*) n, cast(sum(l_orderkey) as bigint) a, cast(sum(l_partkey) as bigint) b, cast(sum(l_linenumber) as bigint) d from lineitem where l_suppkey >= 50",
        ),
        "desc_100": (lambda c: c.scan("events_id", order="desc", limit=100), "select event_id from events order by event_id desc limit 100"),
        "desc_10k": (lambda c: c.scan(key, order="desc", limit=10000, columns=["o_orderkey"]), "select o_orderkey from orders order by o_orderkey desc limit 10000"),
        "desc_range": (
            lambda c: c.scan(key, between("o_orderkey", 5000, 6000), order="desc", columns=["o_orderkey"]),
            "select o_orderkey from orders where o_orderkey between 5000 and 6000",
        ),
        "limit_10": (
            lambda c: c.scan(key, order="asc", limit=10, columns=["o_orderkey", "o_custkey"]),
            "select o_orderkey, o_custkey from orders order by o_orderkey limit 10",
        ),
        "limit_1000": (
            lambda c: c.scan(key, order="asc", limit=1000, columns=["o_orderkey", "o_custkey"]),
            "select o_orderkey, o_custkey from orders order by o_orderkey limit 1000",
        ),
        "range_limit": (
            lambda c: c.scan(key, between("o_orderkey", 3000, 9000), order="asc", limit=100, columns=["o_orderkey", "o_custkey"]),
            "select o_orderkey, o_custkey from orders where o_orderkey between 3000 and 9000 order by o_orderkey limit 100",
        ),
        "covered_range": (
            lambda c: c.scan(key, between("o_orderkey", 1000, 9000)),
            "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey between 1000 and 9000",
        ),
        "covered_small": (
            lambda c: c.scan(key, between("o_orderkey", 1000, 1100)),
            "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey between 1000 and 1100",
        ),
        "active_eq": (
            lambda c: query(c.table("orders"), [c["orders_f"]], ["o_orderkey", "o_custkey"], eq("o_orderkey", 1000), conditions=["o_orderstatus = 'F'"]),
            "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderkey = 1000",
        ),
        "active_range": (
            lambda c: query(c.table("orders"), [c["orders_f"]], ["o_orderkey"], between("o_orderkey", 100, 9000), conditions=["o_orderstatus = 'F'"]).agg(_n()),
            "select count(*) n from orders where o_orderstatus = 'F' and o_orderkey between 100 and 9000",
        ),
        "full_aggregate": (
            lambda c: c.scan(wide).agg(_n(), F.sum("l_orderkey").alias("s")),
            "select count(*) n, cast(sum(l_orderkey) as bigint) s from lineitem",
        ),
        "consecutive_range_sums": (
            # one pass for all ranges: the range number is a group, not twenty scans
            lambda c: c.scan(wide, between("l_suppkey", 1, 100)).groupBy(F.floor((F.col("l_suppkey") - 1) / 5).alias("window")).agg(F.sum("l_orderkey").alias("s")),
            "select cast(floor((l_suppkey - 1) / 5) as bigint) as window, cast(sum(l_orderkey) as bigint) s from lineitem where l_suppkey between 1 and 100 group by 1",
        ),
        "high_sum": (
            lambda c: c.scan(wide, ge("l_suppkey", 90)).agg(F.sum("l_orderkey").alias("s")),
            "select cast(sum(l_orderkey) as bigint) s from lineitem where l_suppkey >= 90",
        ),
    }


ALL = _scans() | _types() | _aggregates() | _workloads()


def _runner(f: Callable[[Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Context(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _runner(f) for name, (f, _) in ALL.items()}
QUERIES["inspect"] = _runner(lambda c: inspect(c["lineitem_wide"]))
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in ALL.items()}
