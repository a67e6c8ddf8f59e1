"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, hex runs) are always reported.
Weak ones (login names, short or unlabelled secrets, endpoints) are reported only
where complementary parts co-occur: an identifier and a secret whose gap is within
``SCOPE`` code points link each other, and an endpoint within the scope of a linked
part completes the credential. The linking is an interval join: parts are cut into
blocks of ``SCOPE`` code points and semi-joined on row and block, so neither all
pairs of a document nor a whole document meet in one place.

All of it is DataFrame operations. One pass of each pattern marks the matches of a text
by a sign that no pattern accepts; the text is then split at the marks, only the lengths
of its pieces are kept, and positions are running sums over those, taken in rows of
their own, so work is linear in text and matches. Patterns whose matches need a certain
sign are tried only where the text has it.

Defined cases: a null text is empty and has no spans; a text of any length is scanned
whole, with any number of matches; weak parts that overlap a strong span are part of it
and not reported again; spans that start together go by kind; repeated rows each get
the same result; a null key is a key like any other, as rows are told apart by a number
of their own; columns to keep travel inside a struct, so their names cannot clash; an
empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import broadcast_if_small, materialize, table

SCOPE = 200


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
_LOGINS = "|".join(_any_case(w) for w in ("username", "user_id", "user", "login", "client_id", "account"))
_TO = r"""["']?\x20*[:=]\x20*["']?"""
#: The patterns, in the order in which kinds are listed.
ASSIGN = rf"({_KEYWORDS}){_TO}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LOGIN = rf"({_LOGINS}){_TO}([A-Za-z0-9_@.+-]+)"
BLOB = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
KINDS = ("assign", "access", "hex", "login", "short", "blob", "endpoint")
LEAST_SECRET = 12

#: What a match needs somewhere in the text, as cheap tests before the pattern; kinds that no test helps are absent.
_NEEDS = {"assign": (":", "="), "login": (":", "="), "access": ("AKIA",), "endpoint": ("://",)}
#: The same matches, found faster: a run is tried from its first sign only, a word from its possible first letters.
_FAST = {
    "assign": f"(?=[PpSsTtAa]){ASSIGN}",
    "access": ACCESS,
    "hex": f"(?<![0-9a-f]){HEX}",
    "login": f"(?=[UuLlCcAa]){LOGIN}",
    "blob": f"(?<![A-Za-z0-9+/]){BLOB}",
    "endpoint": ENDPOINT,
}
#: The sign around matches, and one that stands for it in texts that have it; no pattern accepts either.
_MARK, _OTHER = "\x00", "\x01"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _lengths(body: Column, name: str) -> Column:
    """Code points of each piece of the text: a gap, a match, a gap, a match ... ; null without a match."""
    marked = F.regexp_replace(body, _FAST[name], f"{_MARK}$0{_MARK}")
    needs = [body.contains(x) for x in _NEEDS.get(name, ())]
    if needs:
        marked = F.when(reduce(Column.__or__, needs), marked).otherwise("")
    pieces = F.split(marked, _MARK, -1)
    if name != "assign":
        lengths = F.transform(pieces, lambda x: F.struct(F.char_length(x).alias("size"), F.lit(None).cast("int").alias("value")))
    else:
        value = lambda x: F.char_length(F.regexp_extract(x, ASSIGN, 2))
        lengths = F.transform(pieces, lambda x, i: F.struct(F.char_length(x).alias("size"), F.when(i % 2 == 1, value(x)).alias("value")))
    return F.when(F.size(pieces) > 1, lengths)


def _marked(rows: DataFrame) -> DataFrame:
    """uid, row and the pieces of each kind with matches, of every row (row, text)."""
    body = F.translate(F.coalesce(F.col("text"), F.lit("")), _MARK, _OTHER)
    kinds = [F.struct(F.lit(KINDS.index(n)).alias("kind"), _lengths(F.col("body"), n).alias("pieces")) for n in _FAST]
    found = rows.select("row", body.alias("body")).select("row", F.array(*kinds).alias("found"))
    found = found.select("row", F.filter("found", lambda x: x["pieces"].isNotNull()).alias("found"))
    # It holds lengths, no texts; a number for each row, written with it, stands for the row from here on.
    return materialize(found.withColumn("uid", F.monotonically_increasing_id()))


def _parts(marked: DataFrame) -> DataFrame:
    """(uid, start, kind, end) of all matches."""
    kinds = marked.select("uid", F.explode("found").alias("f")).select("uid", "f.kind", "f.pieces")
    pieces = kinds.select("uid", "kind", F.posexplode("pieces").alias("i", "p")).select("uid", "kind", "i", "p.size", "p.value")
    upto = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = pieces.withColumn("end", F.sum("size").over(upto).cast("int")).where(F.col("i") % 2 == 1)
    kind = F.when(F.col("value") < LEAST_SECRET, KINDS.index("short")).otherwise(F.col("kind"))
    return ends.select("uid", (F.col("end") - F.col("size")).alias("start"), kind.alias("kind"), "end")


def _listing(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(each, ",")


def _blocks(parts: DataFrame, reach: int) -> DataFrame:
    """A row for each block that a part, widened by ``reach``, touches."""
    low = F.floor(F.greatest(F.lit(0), F.col("start") - reach) / SCOPE)
    return parts.withColumn("block", F.explode(F.sequence(low, F.floor((F.col("end") + reach) / SCOPE))))


def _meeting(left: DataFrame, reach: int, right: DataFrame, test: Column) -> DataFrame:
    """Rows of ``left`` that meet a row of ``right`` (os, oe) in their document by ``test``."""
    other = _blocks(right, 0).select(F.col("uid").alias("o"), F.col("block").alias("ob"), F.col("start").alias("os"), F.col("end").alias("oe"))
    same = (F.col("uid") == F.col("o")) & (F.col("block") == F.col("ob"))
    return _blocks(left, reach).join(other, same & test, "left_semi").drop("block").distinct()


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that have a row of ``right`` in their document within the scope."""
    gap = F.greatest(F.col("os") - F.col("end"), F.col("start") - F.col("oe"))
    return _meeting(left, SCOPE, right, gap <= SCOPE)


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, then base and spans (arrays of start, kind, end) of every row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    marked = _marked(rows)
    parts = materialize(_parts(marked))
    strong, weak = parts.where("kind < 3"), parts.where("kind >= 3")
    # Only documents with weak parts have anything to link.
    some = materialize(weak.select(F.col("uid").alias("w")).distinct())
    strong_here = strong.join(broadcast_if_small(some), F.col("uid") == F.col("w"), "left_semi")
    overlap = (F.col("os") < F.col("end")) & (F.col("start") < F.col("oe"))
    inside = _meeting(weak, 0, strong_here, overlap)
    free = materialize(strong_here.unionByName(weak.join(inside, ["uid", "start", "kind", "end"], "left_anti")))
    identifiers, secrets = free.where("kind in (1, 3)"), free.where("kind in (0, 2, 4, 5)")
    linked = materialize(_near(identifiers, secrets).unionByName(_near(secrets, identifiers)))
    told = linked.where("kind >= 3").unionByName(_near(free.where("kind = 6"), linked))
    spans = strong.unionByName(told).groupBy(F.col("uid").alias("u")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("spans"))
    whole = marked.select("uid", "row").join(broadcast_if_small(materialize(spans)), F.col("uid") == F.col("u"), "left")
    every = F.coalesce(F.col("spans"), F.array().cast(_SPAN))
    base = F.filter(every, lambda s: s["kind"] < 3)
    return whole.select(*[F.col("row").getField(c).alias(c) for c in keep], base.alias("base"), every.alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listing(F.col("base")), 256).alias("base_sha256"),
        _listing(F.col("spans")).alias("spans"),
    )


def _sql_spans(name: str, pattern: str, kind: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
      select doc_id, {kind} as kind, pos as start, pos + size as "end" from (
        select doc_id, size, value, list_sum(gaps[1:i])::int + coalesce(list_sum(sizes[1:i-1]), 0)::int as pos from (
          select doc_id, unnest(sizes) as size, unnest(vals) as value, unnest(range(1, len(sizes) + 1)) as i, gaps, sizes from (
            select doc_id, list_transform(regexp_extract_all(body, '{quoted}', 0), lambda x: length(x)) as sizes,
              regexp_extract_all(body, '{quoted}', {2 if name == "assign" else 0}) as vals,
              list_transform(regexp_split_to_array(body, '{quoted}'), lambda x: length(x)) as gaps
            from texts)))"""


def _sql() -> str:
    parts = " union all ".join(
        _sql_spans(n, p, k)
        for n, p, k in (
            ("assign", ASSIGN, f"case when length(value) >= {LEAST_SECRET} then 0 else 4 end"),
            ("access", ACCESS, "1"),
            ("hex", HEX, "2"),
            ("login", LOGIN, "3"),
            ("blob", BLOB, "5"),
            ("endpoint", ENDPOINT, "6"),
        )
    )
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    near = f'a.doc_id = b.doc_id and greatest(b.start - a."end", a.start - b."end") <= {SCOPE}'
    listing = f"""coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || "end", ',' order by start, kind), '')"""
    return f"""
    with texts as (select doc_id, coalesce(text, '') as body from documents),
    found as ({parts}),
    free as (select * from found a where kind < 3 or not exists (
      select 1 from found b where b.doc_id = a.doc_id and b.kind < 3 and b.start < a."end" and a.start < b."end")),
    linked as (
      select * from free a where (kind in (1, 3) and exists (select 1 from free b where {near} and b.kind in (0, 2, 4, 5)))
        or (kind in (0, 2, 4, 5) and exists (select 1 from free b where {near} and b.kind in (1, 3)))),
    told as (
      select * from found where kind < 3
      union all select * from linked where kind >= 3
      union all select * from free a where kind = 6 and exists (select 1 from linked b where {near})),
    base as (select doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access,
      count(*) filter (where kind = 2) as n_hex, {listing} as listed from found where kind < 3 group by doc_id),
    every as (select doc_id, {listing} as spans from told group by doc_id)
    select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(listed, '')) as base_sha256, coalesce(spans, '') as spans
    from texts t left join base using (doc_id) left join every using (doc_id)
    """


ORACLE_SQL = _sql()
