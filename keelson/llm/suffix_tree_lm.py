"""Language-model scoring with a probabilistic suffix tree.

The symbols are the bytes of the lower-cased text, words joined by one space, and an
end sign; a context is up to ``DEPTH`` preceding symbols. A context is retained as a
state if it is frequent and its next-symbol distribution diverges enough from that of
its longest proper suffix. Distributions are interpolated with the next shorter state
by the number of distinct symbols seen (Witten and Bell), down to all symbols, so
every text has a probability. A text is scored symbol by symbol at the longest suffix
of its past that is a state.

Every state that passes the tests is kept, however many there are; the tree is a table
that joins build depth by depth. Its most frequent states, ``HEAD_ROWS`` rows at most and none
rarer than ``HEAD_SHARE``, are sent to all tasks with a Bloom filter of the others. As a suffix of a state is at
least as frequent as the state, a symbol is decided by the head alone unless the filter
finds a longer state in its context; such symbols are counted by document and scored by
a join of their distinct (context, symbol) codes with the table. So where the line is
drawn changes the work, never a score.

Beside it stands a word unigram base. Word counts cover the whole training part and
grow with it: counts of the ``HEAD`` most frequent words are sent to all tasks (bounded
in number and length), tokens outside of them are joined with the full table.

Counts are gathered in one pass and summed by partial aggregates. Sums of logarithms
are kept as fixed-point integers, so reruns agree whatever the order of tasks.

Defined cases: a null or empty text is the end token alone; equal rows get equal
scores, each its own row; ties of contexts in number of occurrences are all in the
head or all outside; a null key is in the training part; without training rows every
symbol is equally likely; a very long text is one row of a task, whose memory is a
small multiple of the text; an empty table gives an empty table; kept columns travel
inside a struct, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import broadcast_if_small, discard, materialize, per_document, table, texts_of

DEPTH = 5
MIN_COUNT = 4
#: Least count times divergence (in nats) from the shorter context.
MIN_GAIN = 2.0
HEAD = 150_000
HEAD_BYTES = 64
#: Rows of the tree, states and their symbols, that are sent to all tasks at most, and the
#: least share of all symbols that follow a state which is sent: what is left to joins is
#: then about the same share of the text at any size.
HEAD_ROWS = 1_000_000
HEAD_SHARE = 5e-7
#: Values of codes that are sent to the tasks that join them; beyond it both sides are shuffled.
VALUE_ROWS = 100_000
#: Bits of the filter of all other states, and the bits that each of them sets.
FILTER_BITS = 1 << 26
FILTER_HASHES = 2
#: Bound of what a task holds before it hands counts on.
FLUSH_WORDS = 150_000
FLUSH_GRAMS = 600_000
CHUNK_BYTES = 1_500_000
SCALE = 1e10
#: Fixed-point steps of a nat in the divergence test.
GAIN_SCALE = 1e4
#: Steps of a doubling in which numbers of occurrences are told apart to draw the line of the head.
STEPS = 16
HELD_OUT = 0

END = 0xFF  # in no UTF-8 text
SYMBOLS = 256
_CONTEXT = [(1 << (8 * d)) - 1 for d in range(DEPTH + 1)]
#: A key of the tree is (context, symbol, state or symbol, depth).
_STATE = 8
_KEY_BITS = 4


def grams_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The (context, symbol) codes of some texts, one after the other, and the end of each text's codes."""
    pad = bytes([END]) * DEPTH
    parts = [b" ".join(w) + bytes([END]) for w in words]
    raw = np.frombuffer(pad + pad.join(parts), np.uint8)
    codes = np.zeros(len(raw) - DEPTH, np.int64)
    for j in range(DEPTH + 1):
        codes = (codes << 8) | raw[j : len(raw) - DEPTH + j]
    sizes = np.array([len(p) for p in parts])
    # between two texts stand DEPTH codes that look back into padding only
    starts = np.cumsum(sizes + DEPTH) - (sizes + DEPTH)
    keep = np.ones(len(codes), bool)
    for j in range(DEPTH):
        keep[starts[1:] - DEPTH + j] = False
    return codes[keep], np.cumsum(sizes)


def _merged(a: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new, n = np.unique(codes, return_counts=True)
    every = np.concatenate((a[0], new))
    u, at = np.unique(every, return_inverse=True)
    return u, np.bincount(at, np.concatenate((a[1], n)), len(u)).astype(np.int64)


def counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, code, n): words with their counts (code null) and grams with theirs (word null)."""

    def batch(words: list[bytes], word_n, codes, code_n) -> pa.RecordBatch:
        w = pa.array(words, pa.binary()).cast(pa.string())
        w = pa.concat_arrays([w, pa.nulls(len(codes), pa.string())])
        c = pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(codes, pa.int64())])
        n = np.concatenate((np.array(word_n, np.int64), np.array(code_n, np.int64)))
        return pa.RecordBatch.from_arrays([w, c, pa.array(n)], names=["word", "code", "n"])

    def run(batches):
        seen: Counter = Counter()
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        grams, held, size = none, [], 0
        for b in batches:
            for start in range(0, b.num_rows, 64):
                for t in texts_of(b.column(0).slice(start, 64)):
                    words = t.lower().split()
                    seen.update(words)
                    seen[b""] += 1
                    held.append(words)
                    size += len(t)
                    if size >= CHUNK_BYTES:
                        grams, held, size = _merged(grams, grams_of(held)[0]), [], 0
                if len(seen) >= FLUSH_WORDS:
                    yield batch(list(seen), list(seen.values()), [], [])
                    seen = Counter()
                if len(grams[0]) >= FLUSH_GRAMS:
                    yield batch([], [], *grams)
                    grams = none
        if held:
            grams = _merged(grams, grams_of(held)[0])
        yield batch(list(seen), list(seen.values()), *grams)

    found = train.select(F.col(f"`{text}`")).mapInArrow(run, "word string, code long, n long")
    return materialize(found.groupBy("word", "code").agg(F.sum("n").alias("n")))


def _step(n: Column) -> Column:
    return F.floor(F.log2(n) * STEPS).cast("int")


def _line(rows: DataFrame, column: str, most: int) -> int:
    """The least step of a count from which on there are no more than ``most`` rows.

    Only numbers of rows by step reach the driver, some hundreds. If the highest step
    alone has too many rows, the line lies above all.
    """
    total, least = 0, 64 * STEPS
    for r in rows.groupBy(_step(F.col(column)).alias("v")).count().orderBy(F.desc("v")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["v"]
    return least


def _fixed(p: Column) -> Column:
    return F.round(F.log10(p) * SCALE).cast("long")


def _levels(grams: DataFrame) -> list[DataFrame]:
    """(ctx, sym, n) by depth."""
    level = grams.select(F.shiftright("code", 8).alias("ctx"), F.col("code").bitwiseAND(F.lit(255)).alias("sym"), "n")
    levels = {DEPTH: level}
    for d in range(DEPTH - 1, -1, -1):
        shorter = F.col("ctx").bitwiseAND(F.lit(_CONTEXT[d])).alias("ctx")
        levels[d] = materialize(levels[d + 1].groupBy(shorter, "sym").agg(F.sum("n").alias("n")))
    return [levels[d] for d in range(DEPTH + 1)]


def _key(ctx: Column, sym: Column, state: int, depth: Column | int) -> Column:
    code = F.shiftleft(F.shiftleft(ctx, 8).bitwiseOR(sym), _KEY_BITS)
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return code.bitwiseOR(depth.cast("long")).bitwiseOR(F.lit(state).cast("long"))


def grow(grams: DataFrame) -> tuple[DataFrame, np.ndarray, float]:
    """The tree (key, value, total) of the retained contexts, the values of the root by symbol, and the number of symbols.

    A row of a state has the logarithm of its back-off weight, a row of one of its
    symbols that of the probability; ``total`` is how often the context occurs.
    """
    levels = _levels(grams)
    root = np.zeros(SYMBOLS)
    for r in levels[0].collect():  # at most SYMBOLS rows
        root[r.sym] = r.n
    smoothed = (root + 0.5) / (root.sum() + 0.5 * SYMBOLS)
    # with p, the probability of a seen symbol in a context: that of the longest state which ends the context
    above = levels[0].select(
        "ctx", "sym", "n", F.lit(int(root.sum())).cast("long").alias("total"), ((F.col("n") + 0.5) / F.lit(float(root.sum() + 0.5 * SYMBOLS))).alias("p")
    )
    tree = None
    for d in range(1, DEPTH + 1):
        up = above.select(F.col("ctx").alias("up"), F.col("sym").alias("s"), F.col("n").alias("m"), F.col("total").alias("up_total"), F.col("p").alias("q"))
        shorter = F.col("ctx").bitwiseAND(F.lit(_CONTEXT[d - 1]))
        rows = levels[d].join(up, (shorter == F.col("up")) & (F.col("sym") == F.col("s")))
        own = Window.partitionBy("ctx")  # at most SYMBOLS rows each
        ratio = F.log(F.col("n") / F.col("total")) - F.log(F.col("m") / F.col("up_total"))
        rows = rows.withColumn("total", F.sum("n").over(own)).where(F.col("total") >= MIN_COUNT)
        rows = rows.withColumn("kinds", F.count("*").over(own))
        rows = rows.withColumn("gain", F.sum(F.round(F.col("n") * ratio * GAIN_SCALE).cast("long")).over(own))
        state = F.col("gain") >= int(MIN_GAIN * GAIN_SCALE)
        p = (F.col("n") + F.col("kinds") * F.col("q")) / (F.col("total") + F.col("kinds"))
        rows = rows.withColumn("state", state).withColumn("p", F.when(state, p).otherwise(F.col("q")))
        rows = rows.select("ctx", "sym", "n", "total", "kinds", "state", "p", (F.min("sym").over(own) == F.col("sym")).alias("first"))
        if d < DEPTH:
            above = rows = materialize(rows)
        symbol = F.struct(_key(F.col("ctx"), F.col("sym"), 0, d).alias("key"), _fixed(F.col("p")).alias("value"))
        back = _fixed(F.col("kinds") / (F.col("total") + F.col("kinds")))
        whole = F.struct(_key(F.col("ctx"), F.lit(0).cast("long"), _STATE, d).alias("key"), back.alias("value"))
        both = F.when(F.col("first"), F.array(symbol, whole)).otherwise(F.array(symbol))
        part = rows.where("state").select(F.explode(both).alias("x"), "total").select("x.key", "x.value", "total")
        tree = part if tree is None else tree.unionByName(part)
    tree = materialize(tree)
    for level in levels[:DEPTH]:
        discard(level)
    return tree, np.rint(np.log10(smoothed) * SCALE).astype(np.int64), float(root.sum())


def _places(contexts: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    """The bits of a context in the filter."""
    x = contexts.astype(np.uint64) * np.uint64(8) + np.uint64(depth)
    out = []
    for turn in range(FILTER_HASHES):
        y = (x + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((y ^ (y >> np.uint64(32))) & np.uint64(bits - 1))
    return out


def _filter(rest: DataFrame, bits: int) -> np.ndarray:
    """The filter of the states among the rows ``rest`` of the tree: ``bits`` bits, however many they are."""

    def run(batches):
        words = np.zeros(bits // 64, np.uint64)
        for b in batches:
            keys = b.column(0).to_numpy()
            for d in range(1, DEPTH + 1):
                for at in _places(keys[(keys & 7) == d] >> (8 + _KEY_BITS), d, bits):
                    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        own = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(words[own].view(np.int64))], names=["word", "bits"])

    states = rest.select("key").where(F.col("key").bitwiseAND(F.lit(_STATE)) != 0)
    found = states.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


class SuffixTree:
    """The head of the tree as sorted arrays by depth, the root, and the filter of all other states."""

    def __init__(self, key: np.ndarray, value: np.ndarray, root: np.ndarray, others: np.ndarray):
        self.root, self.others, self.bits = root, others, len(others) * 64
        self.any = bool(others.any())
        order = np.argsort(key)
        key, value = key[order], value[order]
        depth, state = key & (_STATE - 1), (key & _STATE) != 0
        codes = key >> _KEY_BITS
        self.symbols = [(codes[(depth == d) & ~state], value[(depth == d) & ~state]) for d in range(DEPTH + 1)]
        self.states = [(codes[(depth == d) & state] >> 8, value[(depth == d) & state]) for d in range(DEPTH + 1)]

    def outside(self, contexts: np.ndarray, depth: int) -> np.ndarray:
        """Which contexts may be states outside of the head; states are never missed."""
        out = np.ones(len(contexts), bool)
        for at in _places(contexts, depth, self.bits):
            out &= (self.others[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out

    def values(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each code's logarithm at the longest state of the head, and which codes a longer one may decide."""
        out, open_ = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        met = np.zeros(len(codes), bool)  # a state of the head, so every shorter one is in the head too
        left = np.arange(len(codes))
        for d in range(DEPTH, 0, -1):
            mine = codes[left] & ((_CONTEXT[d] << 8) | 255)
            hit, value = _found(*self.symbols[d], mine)
            out[left[hit]] += value[hit]
            left, mine = left[~hit], mine[~hit] >> 8
            hit, value = _found(*self.states[d], mine)
            out[left[hit]] += value[hit]
            met[left[hit]] = True
            if self.any:
                new = ~met[left]
                open_[left[new]] |= self.outside(mine[new], d)
        out[left] += self.root[codes[left] & 255]
        return out, open_


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def text_scores(words: list[list[bytes]], tree: SuffixTree) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sum of each text's decided symbols, and (end of each text's, code, count) of all others."""
    codes, ends = grams_of(words)
    u, inverse = np.unique(codes, return_inverse=True)
    value, open_ = tree.values(u)
    value[open_] = 0
    running = np.concatenate(([0], np.cumsum(value[inverse])))
    sums = running[ends] - running[np.concatenate(([0], ends[:-1]))]
    at = np.flatnonzero(open_[inverse])
    pairs, n = np.unique(np.searchsorted(ends, at, side="right") * len(u) + inverse[at], return_counts=True)
    return sums, (np.searchsorted(pairs // max(1, len(u)), np.arange(len(words)), side="right"), u[pairs % max(1, len(u))], n)


def _values(codes: DataFrame, tree: DataFrame, root: np.ndarray) -> DataFrame:
    """(c, v): the logarithm of each distinct code by the whole tree.

    A symbol seen in a context is seen in every shorter one, so the deepest hit decides
    and the states beyond it, which lack the symbol, weigh it down.
    """
    spark = codes.sparkSession
    steps = []
    for d in range(1, DEPTH + 1):
        ctx = F.shiftright("code", 8).bitwiseAND(F.lit(_CONTEXT[d]))
        steps.append(F.struct(F.lit(d).alias("d"), F.lit(False).alias("state"), _key(ctx, F.col("code").bitwiseAND(F.lit(255)), 0, d).alias("k")))
        steps.append(F.struct(F.lit(d).alias("d"), F.lit(True).alias("state"), _key(ctx, F.lit(0).cast("long"), _STATE, d).alias("k")))
    asked = codes.select("code", F.explode(F.array(*steps)).alias("x")).select("code", "x.*")
    hits = asked.join(tree.select("key", "value"), F.col("k") == F.col("key"), "left")
    symbol = F.col("value").isNotNull() & ~F.col("state")
    weights = [F.sum(F.when(F.col("state") & (F.col("d") == d), F.col("value"))).alias(f"w{d}") for d in range(1, DEPTH + 1)]
    deepest = F.coalesce(F.max(F.when(symbol, F.col("d"))), F.lit(0)).alias("deepest")
    found = hits.groupBy("code").agg(F.max_by("value", F.when(symbol, F.col("d"))).alias("hit"), deepest, *weights)
    base = spark.createDataFrame([(i, int(v)) for i, v in enumerate(root)], "sym long, base long")  # SYMBOLS rows
    found = found.join(F.broadcast(base), F.col("code").bitwiseAND(F.lit(255)) == F.col("sym"))
    total = F.when(F.col("deepest") > 0, F.col("hit")).otherwise(F.col("base"))
    for d in range(1, DEPTH + 1):
        total += F.when(F.col("deepest") < d, F.coalesce(F.col(f"w{d}"), F.lit(0))).otherwise(0)
    return found.select(F.col("code").alias("c"), total.alias("v"))


def _lists(ends: np.ndarray, columns: dict[str, pa.Array]) -> pa.Array:
    """Lists of structs, given where each list ends."""
    flat = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), flat)


def _base(n: Column, total: int, vocabulary: int) -> Column:
    return F.round(F.log10((n + 0.1) / F.lit(total + 0.1 * (vocabulary + 1))) * SCALE).cast("long")


def score(docs: DataFrame, train: DataFrame, columns: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``columns``, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    found = counts(train, text)
    vocabulary = found.where(F.col("code").isNull()).select("word", "n")
    total, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree, root, symbols = grow(found.where(F.col("code").isNotNull()).select("code", "n"))
    line = max(_line(tree, "total", HEAD_ROWS), int(np.floor(np.log2(max(1.0, HEAD_SHARE * symbols)) * STEPS)))
    top = tree.where(_step(F.col("total")) >= line).select("key", "value").toArrow()  # at most HEAD_ROWS rows
    others = _filter(tree.where(_step(F.col("total")) < line), FILTER_BITS)
    head_tree = SuffixTree(top.column("key").to_numpy(), top.column("value").to_numpy(), root, others)
    # at most HEAD words of HEAD_BYTES bytes
    usual = vocabulary.where(F.octet_length("word") <= HEAD_BYTES)
    top = usual.where(_step(F.col("n")) >= _line(usual, "n", HEAD)).select("word", _base(F.col("n"), total, kinds).alias("value")).toArrow()
    head = dict(zip(top.column("word").cast(pa.binary()).to_pylist(), top.column("value").to_pylist())) if total else {}
    sent, open_states = sc.broadcast((head_tree, head)), head_tree.any
    del top, head, head_tree, others
    kind = "n_tokens long, head_known long, head_base long, head_model long, tail array<struct<word:string,tf:int>>, codes array<struct<code:long,tf:int>>"

    def make():
        known = sent.value[1].get

        def work(texts):
            n_tokens, head_known, head_base, held = [], [], [], []
            words_out, tf_out, ends = [], [], []
            for t in texts:
                words = t.lower().split()
                held.append(words)
                own, known_here, base_here = Counter(words), 0, 0
                own[b""] += 1
                for w, tf in own.items():
                    p = known(w)
                    if p is None:
                        words_out.append(w)
                        tf_out.append(tf)
                    else:
                        known_here += tf
                        base_here += tf * p
                n_tokens.append(len(words) + 1)
                head_known.append(known_here)
                head_base.append(base_here)
                ends.append(len(words_out))
            sums, (code_ends, codes, n) = text_scores(held, sent.value[0])
            tail = {"word": pa.array(words_out, pa.binary()).cast(pa.string()), "tf": pa.array(tf_out, pa.int32())}
            return {
                "n_tokens": n_tokens,
                "head_known": head_known,
                "head_base": head_base,
                "head_model": pa.array(sums),
                "tail": _lists(np.array(ends), tail),
                "codes": _lists(code_ends, {"code": pa.array(codes, pa.int64()), "tf": pa.array(n, pa.int32())}),
            }

        return work

    passed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    # Written with a number for each row, so that what follows joins rows, not keys that may repeat.
    rows = materialize(per_document(passed, ["row"], "text", kind, make).withColumn("uid", F.monotonically_increasing_id()))
    sent.destroy()
    none = F.lit(0).cast("long")
    words = rows.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.tf").join(vocabulary, "word", "left")
    sums = words.select(
        "uid",
        F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0).cast("long").alias("known"),
        (F.col("tf") * _base(F.coalesce("n", F.lit(0)), total, kinds)).alias("base"),
        none.alias("model"),
    )
    codes = rows.select("uid", F.explode("codes").alias("t")).select("uid", "t.code", "t.tf")
    if open_states:
        asked = codes.groupBy("code").agg(F.count("*").alias("asked")).select("code")
        values = broadcast_if_small(materialize(_values(asked, tree, root)), VALUE_ROWS)
        model = codes.join(values, F.col("code") == F.col("c"))
        sums = sums.unionByName(model.select("uid", none.alias("known"), none.alias("base"), (F.col("tf") * F.col("v")).alias("model")))
    sums = sums.groupBy(F.col("uid").alias("u")).agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("model").alias("model"))
    whole = rows.drop("tail", "codes").join(sums, F.col("uid") == F.col("u"), "left")

    def both(head: str, tail: str) -> Column:
        return F.col(head) + F.coalesce(F.col(tail), F.lit(0))

    return whole.select(
        *[F.col("row").getField(c).alias(c) for c in columns],
        "n_tokens",
        both("head_known", "known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (both("head_base", "base") / SCALE).alias("base_score"),
        (both("head_model", "model") / SCALE).alias("score"),
    )


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    held_out = F.coalesce(remainder == HELD_OUT, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return score(docs, docs.where(~F.col("held_out")), ["doc_id", "held_out"])
