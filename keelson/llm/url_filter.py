"""URL filters: rules first, then a blocked Bloom filter before an exact hash join.

Rules name a host (with its subdomains) and a path prefix; the longest fitting rule
decides. Other URLs are blocked if their canonical form is listed. The list may be
large, so it is not broadcast: a blocked Bloom filter of it is (256-bit blocks, eight
bits in the block that the URL's hash selects). URLs that it rules out are done
without a shuffle; the few possible hits go to a hash join on the canonical URL that
removes false positives. The filter has at most ``MAX_BLOCKS`` blocks, a bound of
3 MB; a longer list raises the share of false positives, never changes a verdict.

All of it is DataFrame operations, so it stays in generated code.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is
allowed, unless a rule fits; of fitting rules of equal length the first given decides; a
URL of any length is judged whole; repeated URLs get the same verdict, and repeated or
null list entries count once or not at all; an empty list blocks nothing; an empty table
gives an empty table; columns to keep travel inside a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import lower_ascii, materialize, table

#: Fixed rules: verdict, host, path prefix.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Names within hosts whose URLs the registered query lists ...
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
#: ... besides one in so many of all other canonical URLs, by a hash that no host or path gives away.
LISTED_CLASSES = 16
#: Query parameters that do not change what a URL shows.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 16

_AFTER = r"^.*?://"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host/path?query without www., default ports, index pages, closing slashes, tracking and fragments."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host_of(url) != "", F.concat(host, path, tail))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: str) -> list[Column]:
    """Four 64-bit words of the block, two bits in each."""
    second = f"xxhash64({url}, 71)"
    bit = "shiftleft(1L, cast(shiftrightunsigned({h}, {n}) & 63 as int))"
    return [F.expr(f"{bit.format(h=second, n=12 * i)} | {bit.format(h=second, n=12 * i + 6)}") for i in range(4)]


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(block, w0 .. w3): the blocks that have bits; at most ``blocks`` rows."""
    marked = listed.select(_block(url, blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(url))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def judge(pages: DataFrame, keep: list[str], listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``keep``, host, path, rule and verdict of each row; ``listed`` has canonical URLs in its first column."""
    column = F.col(f"`{url}`")
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        host_of(column).alias("host"),
        path_of(column).alias("path"),
        canonical(column).alias("canon"),
    )
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(_fits(F.col("host"), F.col("path"), r), r) for r in longest]
    rows = rows.withColumn("rule", F.coalesce(*[F.when(f, F.lit(r[1] + r[2])) for f, r in fits], F.lit(None).cast("string")))
    by_rule = F.coalesce(*[F.when(F.col("rule") == r[1] + r[2], F.lit(r[0])) for _, r in fits], F.lit("allow"))

    listed = materialize(listed.toDF("listed").where("listed is not null").distinct())
    n = listed.count()
    blocks = min(MAX_BLOCKS, 1 << max(0, (n * BITS_PER_URL // 256)).bit_length())
    words = F.broadcast(bloom(listed, "listed", blocks))
    probed = rows.join(words, F.col("rule").isNull() & (_block("canon", blocks) == F.col("block")), "left")
    possible = F.col("w0").isNotNull() & F.col("canon").isNotNull()
    for i, mask in enumerate(_masks("canon")):
        possible &= F.col(f"w{i}").bitwiseAND(mask) == mask
    probed = probed.withColumn("possible", F.coalesce(possible, F.lit(False)))
    done = probed.where(~F.col("possible")).select("row", "host", "path", "rule", by_rule.alias("verdict"))
    hits = probed.where("possible").join(listed.hint("shuffle_hash"), F.col("canon") == F.col("listed"), "left")
    hits = hits.select(
        "row", "host", "path", "rule", F.when(F.col("listed").isNotNull(), "block").otherwise("allow").alias("verdict")
    )
    return done.unionByName(hits).select(
        *[F.col("row").getField(c).alias(c) for c in keep], "host", "path", "rule", "verdict"
    )


def _listed_class(canon: Column) -> Column:
    return F.conv(F.substring(F.md5(canon.cast("binary")), 1, 8), 16, 10).cast("long") % LISTED_CLASSES == 0


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # The list of this query: every canonical URL whose host carries a listed name, and a hash class of the others.
    urls = pages.select(host_of(F.col("url")).alias("host"), canonical(F.col("url")).alias("canon"))
    named = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, LISTED_NAMES)))
    return judge(pages, ["page_id"], urls.where(named | _listed_class(F.col("canon"))).select("canon"))


_CANON = r"""
    case when host <> '' then
      regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '')
      || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end
    end"""

ORACLE_SQL = rf"""
with parts as (
  select page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), ''), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) as kept
  from pages),
urls as (select page_id, host, path, {_CANON} as canon from parts),
listed as (
  select distinct canon from urls
  where list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
    or ('0x' || substr(md5(canon), 1, 8))::bigint % {LISTED_CLASSES} = 0),
ruled as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/en/') then 'com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/de/') then 'net/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/es/') then 'org/es/'
  end as rule
  from urls)
select page_id, host, path, rule,
  case when rule in ('example.net/de/8', 'com/en/', 'org/es/') then 'block'
       when rule is not null then 'allow'
       when canon in (select canon from listed where canon is not null) then 'block'
       else 'allow' end as verdict
from ruled
"""
