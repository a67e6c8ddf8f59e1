"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths measure how many characters of a text lie
inside n-grams and lines that occur more than once. A text is rejected when one of
these shares exceeds the limit for its length, or when a base rule fails. A sentence that
stands twice is a large share of a short text and says little; from ``LONG_WORDS`` words
on, half of each limit is allowed.

Defined cases: a null or empty text has no words and fails the base rule of a least
number of words; a very long text is measured whole, in memory of a small multiple of it;
every row is judged by itself, so ties, repeated rows and other columns, whatever their
names, do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import per_document, table

#: Largest share of word characters inside repeated n-grams, by n-gram length.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Largest share of word characters inside lines equal to an earlier line.
LINE_LIMIT = 0.30
#: Texts of so many words may reach this part of each limit.
LONG_WORDS, LONG_PART = 300, 0.5
MIN_WORDS = 10
BASE_WINDOW = 5
BASE_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double"
)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """64-bit values of word numbers, spread so that sums of products rarely collide."""
    x = (ids + np.uint64(1)) * _STEP
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Which hashes occur at least twice."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    marks = np.zeros(len(hashes), bool)
    marks[order[1:]] |= same
    marks[order[:-1]] |= same
    return marks


def _covered(marks: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which words lie inside a marked window of ``n`` words."""
    edges = np.zeros(total + 1, np.int64)
    starts = np.flatnonzero(marks)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(data: bytes, ngram_limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> dict:
    """All measures and both verdicts of one text."""
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    is_char = (raw & 0xC0) != 0x80
    n_chars = int(np.count_nonzero(is_char & ~space))
    words = data.split()
    n = len(words)
    part = LONG_PART if n >= LONG_WORDS else 1.0
    symbols = sum(map(data.count, (bytes([s]) for s in SYMBOLS)))

    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in data.split(b"\n"):
        if not line.strip():
            continue
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        else:
            seen.add(line)

    repeat_words, worst, rejected = 0, 0.0, False
    if n >= BASE_WINDOW:
        ids: dict[bytes, int] = {}
        numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
        if len(ids) < n:
            flags = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
            starts, ends = np.flatnonzero(flags == -1), np.flatnonzero(flags == 1)
            before = np.concatenate(([0], np.cumsum(is_char)))
            lengths = before[ends] - before[starts]
            values = _mixed(numbers)
            hashes, done = values.copy(), 1
            for length in sorted({BASE_WINDOW, *ngram_limits}):
                if n < length:
                    break
                while done < length:  # roll: one more word on the right
                    hashes = hashes[: n - done] * _BASE + values[done:]
                    done += 1
                marks = _repeated(hashes)
                if not marks.any():
                    break  # longer n-grams cannot repeat either
                inside = _covered(marks, length, n)
                if length == BASE_WINDOW:
                    repeat_words = int(np.count_nonzero(inside))
                if length in ngram_limits:
                    share = float(lengths[inside].sum()) / n_chars
                    worst = max(worst, share)
                    rejected |= share > part * ngram_limits[length]
    line_share = dup_line_chars / n_chars if n_chars else 0.0
    failed = n < MIN_WORDS or 100 * repeat_words > BASE_REPEAT_PERCENT * n
    return {
        "n_words": n,
        "word_chars": n_chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": not failed and not rejected and line_share <= part * line_limit,
        "dup_line_share": line_share,
        "dup_ngram_share": worst,
    }


def _make():
    def work(texts: list[bytes]) -> dict[str, list]:
        rows = [measure(t) for t in texts]
        return {k: [r[k] for r in rows] for k in measure(b"")}

    return work


def judge(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row, and the measures and verdicts of its text."""
    return per_document(docs, columns, text, COLUMNS, _make)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is kept, unchanged and in one pass over the table."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    judged = judge(whole, ["row"])
    return judged.where("kept").select(*[F.col("row").getField(c).alias(c) for c in names])


_PART = f"(case when n_words >= {LONG_WORDS} then {LONG_PART}::double else 1.0::double end)"
_LIMITS = ", ".join(f"({n}, {share})" for n, share in NGRAM_LIMITS.items())

ORACLE_SQL = rf"""
with docs as (
  select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
base as (
  select doc_id, body, ws, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]')) as n_symbols from docs),
lines as (
  select doc_id, line, row_number() over (partition by doc_id, line order by i) as nth
  from (select doc_id, unnest(string_split(body, chr(10))) as line, unnest(range(1, len(string_split(body, chr(10))) + 1)) as i from docs)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup_lines as (
  select doc_id, count(*) as n_dup_lines,
    sum(list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: length(x))))::bigint as chars
  from lines where nth > 1 group by doc_id),
limits as (select * from (values {_LIMITS}) t(n, share)),
grams as (
  select doc_id, n, i, ws[i : i + n - 1] as g
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from base, limits where len(ws) >= n)),
twice as (select doc_id, n, i from (select doc_id, n, i, count(*) over (partition by doc_id, n, g) as c from grams) where c > 1),
inside as (select distinct doc_id, n, unnest(range(i, i + n)) as p from twice),
shares as (
  select s.doc_id, s.n, count(*) as n_inside, sum(length(b.ws[s.p]))::bigint as chars from inside s join base b using (doc_id) group by 1, 2),
worst as (
  select s.doc_id, max(s.chars / b.word_chars::double) as share, bool_or(s.chars / b.word_chars::double > l.share * {_PART}) as rejected,
    max(case when s.n = {BASE_WINDOW} then n_inside else 0 end) as n_repeat
  from shares s join base b using (doc_id) join limits l using (n) group by 1)
select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat, 0) as n_repeat_words,
  n_words < {MIN_WORDS} or 100 * coalesce(n_repeat, 0) > {BASE_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * coalesce(n_repeat, 0) > {BASE_REPEAT_PERCENT} * n_words)
    and not coalesce(rejected, false) and dup_line_share <= {LINE_LIMIT} * {_PART} as kept,
  dup_line_share, coalesce(share, 0.0)::double as dup_ngram_share
from (
  select b.doc_id, b.n_words, b.word_chars, b.n_symbols, d.n_dup_lines, w.n_repeat, w.rejected, w.share,
    case when b.word_chars > 0 then coalesce(d.chars, 0) / b.word_chars::double else 0.0::double end as dup_line_share
  from base b left join dup_lines d using (doc_id) left join worst w using (doc_id))
"""
