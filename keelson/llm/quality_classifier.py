"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Each word piece has a sparse random index vector; its word vector is the sum of the
index vectors around it, over every text of the table. A document is the mean and the
spread of the vectors of its pieces and the steps from each to the next, and a two-layer
numpy network turns that into a score, calibrated by one temperature fitted on training
rows that the network did not see.

Words share ``BUCKETS`` hashed places, so the vectors have a fixed size whatever the
vocabulary is. Word vectors need no labels and are summed over all rows; the network is
fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by hash; every row of the table is
scored. Only the sums by place and the pooled vectors of the sample reach the driver,
never texts.

Defined cases: a null or empty text has the pooled vector zero and still gets a
score; a document with several labels counts with the smallest, labels that are null
do not count; rows equal in key and text are one row of the sample, so repeated or null
keys do not enlarge it, and a null key has no label; ties in the order of the sample are
such rows only; without labels of both kinds every score is the share of label 1, or 0.5
without labels; repeated rows get the same score; a very long text is read piece by piece
and pooled in a bounded size; an empty table gives an empty table; kept columns travel
inside a struct, so their names cannot clash. Labels, language, source and key are never
inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import materialize, per_document, table, texts_of

BUCKETS = 1 << 14
DIMENSIONS = 64
NONZERO = 4
REACH = 2
#: The bound of the labelled sample.
TRAIN_ROWS = 10_000
HIDDEN = 32
#: Training steps of so many rows each, whatever the size of the sample.
STEPS = 5_000
BATCH = 64
#: Pull of the weights towards zero, decoupled from the gradients.
DECAY = 1e-2
SEED = 11
THRESHOLD = 0.7
HELD_OUT = 2
FEATURES = 2 * DIMENSIONS + 2
#: Characters of a text that are cut into pieces at a time, and pieces that are summed at a time.
CHUNK_CHARS = 1 << 20
CHUNK_PIECES = 1 << 16
#: Pieces whose places a task remembers.
KNOWN_PIECES = 200_000

#: Runs of letters, of digits and of other signs.
_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
_SPACE = re.compile(r"\s")


class Places(dict):
    """The hashed place of each piece; negative where capitals count as a piece of their own before it."""

    def __missing__(self, piece: str) -> int:
        if len(self) >= KNOWN_PIECES:
            self.clear()
        letters = piece.isalpha()
        place = zlib.crc32((piece.lower() if letters else piece).encode()) % (BUCKETS - 1) + 1
        if letters and len(piece) > 1 and piece.isupper():
            place = -place
        self[piece] = place
        return place

    def of(self, text: bytes) -> np.ndarray:
        return np.concatenate([*self._chunks(text.decode("utf-8", "replace")), np.zeros(0, np.int32)])

    def _chunks(self, text: str) -> Iterator[np.ndarray]:
        start = 0
        while start < len(text):
            # no piece goes across white space
            cut = _SPACE.search(text, start + CHUNK_CHARS)
            end = cut.start() if cut else len(text)
            found = np.array(list(map(self.__getitem__, _PIECE.findall(text, start, end))), np.int32)
            capitals = np.flatnonzero(found < 0)
            yield np.insert(np.abs(found), capitals, 0) if capitals.size else found
            start = end


def index_vectors() -> np.ndarray:
    """One sparse vector of +1 and -1 for each bucket, from the seed alone, and a zero one to stand between texts."""
    random = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS + 1, DIMENSIONS), np.int8)
    places = random.random((BUCKETS, DIMENSIONS)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    out[np.arange(BUCKETS)[:, None], places] = random.choice([-1, 1], (BUCKETS, NONZERO))
    return out


class Contexts:
    """Sums, by place, of the index vectors within ``REACH`` of each piece, over many texts."""

    def __init__(self):
        index = index_vectors()
        # The entries of +1 and -1 of each place, one row for each of them; the vector between texts has none.
        at, entry = np.nonzero(index)
        order = np.argsort(at, kind="stable")
        self.entries = np.zeros((NONZERO, BUCKETS + 1), np.int64)
        self.signs = np.zeros((NONZERO, BUCKETS + 1), np.int64)
        self.entries[:, :BUCKETS] = entry[order].reshape(BUCKETS, NONZERO).T
        self.signs[:, :BUCKETS] = index[at, entry][order].reshape(BUCKETS, NONZERO).T
        self.sums = np.zeros((BUCKETS + 1, DIMENSIONS), np.int64)
        self.counts = np.zeros(BUCKETS + 1, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, places: np.ndarray) -> None:
        for start in range(0, len(places), CHUNK_PIECES):
            # a part takes along what stands within reach of it, which is counted with its own part
            low, high = max(0, start - REACH), min(len(places), start + CHUNK_PIECES + REACH)
            own = np.zeros(high - low, bool)
            own[start - low : start - low + CHUNK_PIECES] = True
            self.held.append((places[low:high], own))
            self.size += high - low
            if self.size >= CHUNK_PIECES:
                self.sum_up()

    def sum_up(self) -> None:
        if not self.held:
            return
        gap = (np.full(REACH, BUCKETS, np.int32), np.zeros(REACH, bool))
        parts = [gap, *[x for h in self.held for x in (h, gap)]]
        places, own = np.concatenate([p for p, _ in parts]), np.concatenate([o for _, o in parts])
        at = np.flatnonzero(own)
        sums, rows = self.sums.reshape(-1), places[at].astype(np.int64) * DIMENSIONS
        for step in range(-REACH, REACH + 1):
            if step:
                near = places[at + step]
                for entry, sign in zip(self.entries, self.signs):
                    np.add.at(sums, rows + entry[near], sign[near])
        self.counts += np.bincount(places[at], minlength=BUCKETS + 1)
        self.held, self.size = [], 0


def pooled(places: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A document: weighted mean and spread of its vectors, their mean squared step from piece to piece, and how often one is taken at all."""
    out = np.zeros(FEATURES)
    if places.size:
        found, n = np.unique(places, return_counts=True)
        own, w = vectors[found], (weights[found] * n)[:, None]
        mean = (own * w).sum(0) / w.sum()
        out[:DIMENSIONS] = mean
        out[DIMENSIONS : 2 * DIMENSIONS] = np.sqrt((w * (own - mean) ** 2).sum(0) / w.sum())
        steps = places.size - 1
        for start in range(0, steps, CHUNK_PIECES):
            part = places[start : start + CHUNK_PIECES + 1]
            moved = np.flatnonzero(part[1:] != part[:-1])
            step = vectors[part[moved + 1]] - vectors[part[moved]]
            out[-2] += np.einsum("ij,ij->", step, step) / steps
            out[-1] += moved.size / steps
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer, one logit and its temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(0, ((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the cross entropy of four fifths of the rows, the temperature on the rest."""
    random = np.random.default_rng(SEED)
    n, width = x.shape
    if not n or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        zero = np.zeros(width)
        return Network(zero, zero + 1, np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = random.permutation(n)
    rest, fit = order[: n // 5], order[n // 5 :]
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    z = (x - mean) / scale
    p = [random.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for turn in range(1, STEPS + 1):
        rate = 3e-3 * (1 - (turn - 1) / STEPS)
        rows = fit[random.integers(0, len(fit), min(BATCH, len(fit)))]
        inner = z[rows] @ p[0] + p[1]
        hidden = np.maximum(0, inner)
        error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - y[rows]) / len(rows)
        back = error[:, None] * p[2] * (inner > 0)
        for i, g in enumerate((z[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] * (1 - rate * DECAY) - rate * (m[i] / (1 - 0.9**turn)) / (np.sqrt(v[i] / (1 - 0.999**turn)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(rest):
        raw = net.logits(x[rest])

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, np.where(y[rest] > 0, -raw, raw) / t)))

        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _word_vectors(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Unit word vectors and weights by place, from integer sums over all rows."""
    names = [f"d{i}" for i in range(DIMENSIONS)]

    def run(batches):
        seen, known = Contexts(), Places()
        for batch in batches:
            for t in texts_of(batch.column(0)):
                seen.add(known.of(t))
        seen.sum_up()
        found = np.flatnonzero(seen.counts[:BUCKETS])
        columns = [pa.array(found), pa.array(seen.counts[found]), *[pa.array(seen.sums[found, i]) for i in range(DIMENSIONS)]]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "n", *names])

    parts = docs.select(F.col(f"`{text}`")).mapInArrow(run, "place long, n long, " + ", ".join(f"{c} long" for c in names))
    # At most BUCKETS rows, whatever the number of tasks.
    whole = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).toArrow()
    places = whole.column("place").to_numpy()
    sums, counts = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS, np.int64)
    counts[places] = whole.column("n").to_numpy()
    for i, c in enumerate(names):
        sums[places, i] = whole.column(c).to_numpy()
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = (sums / np.where(norm > 0, norm, 1)).astype(np.float32)
    # Frequent pieces weigh less; places without a piece have no vector.
    share = counts / max(1, counts.sum())
    return vectors, np.where(counts > 0, 1e-3 / (1e-3 + share), 1e-6).astype(np.float32)


def score(docs: DataFrame, labelled: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` and the score of every row of ``docs``; ``labelled`` (text, label) is the bounded sample."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(_word_vectors(docs, text))

    def features():
        known = Places()

        def work(texts):
            return {"x": [pooled(known.of(t), *sent.value).tolist() for t in texts]}

        return work

    rows = per_document(labelled, ["label"], "text", "x array<double>", features).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, FEATURES)
    y = np.array(rows.column("label").to_pylist(), float)
    order = np.lexsort((*x.T[:3], x[:, -2], y))  # the same order whatever tasks came first
    net = sc.broadcast(train(x[order], y[order]))

    def judged():
        known = Places()

        def work(texts):
            rows = np.array([pooled(known.of(t), *sent.value) for t in texts])
            return {"score": net.value.scores(rows).tolist()}

        return work

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    scored = per_document(whole, ["row"], "text", "score double", judged)
    return scored.select(*[F.col("row").getField(c).alias(c) for c in columns], "score")


def sample_of(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` documents, given (doc_id, text) and one label for each doc_id.

    Chosen by hashes of key and text, so that texts are only joined once they are few.
    """
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    known = hashed.select("doc_id", "h").join(labels, "doc_id").groupBy("doc_id", "h").agg(F.min("label").alias("label"))
    chosen = materialize(known.orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h").limit(rows))
    chosen = chosen.select(F.col("doc_id").alias("d"), F.col("h").alias("t"), "label")
    # at most that many rows, and as many after equal ones are put together
    found = hashed.join(F.broadcast(chosen), (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("t")))
    return found.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held_out = F.coalesce(remainder == HELD_OUT, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & ~held_out)
    labels = labels.groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    scored = score(docs, sample_of(docs, labels), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
