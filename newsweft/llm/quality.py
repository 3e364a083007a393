"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every word and every word shape has a sparse ternary index vector, drawn from its hash.  A word's vector is the sum of
its neighbours' index vectors over a bounded sample of labelled texts; words outside the sample's vocabulary are
represented by their shape.  A document is the mean of its words' vectors, the mean of its shapes' vectors and a few
ratios; a two-layer numpy network reads it, and one temperature, fitted on rows that the network has not seen,
calibrates its probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from newsweft.llm.common import freeing, is_held_out, materialise, slabs, word_hashes, words_of

#: Labelled rows that the model is fitted on at most, by hash order of their ids; its vocabulary and least document count.
FIT_ROWS, VOCABULARY, LEAST_DOCS = 6000, 20000, 4
DIM, NONZERO, WINDOW, SHAPES = 24, 4, 2, 1 << 12
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 60, 128, 3e-3, 1e-4, 7
ACCEPT = 0.7
_SLAB = 1 << 20
_RATIOS = 6


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """NONZERO entries of +1 or -1 among DIM, drawn from each 64-bit hash."""
    h = hashes.astype(np.uint64)
    out = np.zeros((len(h), DIM), np.float32)
    rows = np.arange(len(h))
    for _ in range(NONZERO):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(32))
        np.add.at(out, (rows, (h >> np.uint64(8)) % np.uint64(DIM)), np.where(h & np.uint64(1), 1.0, -1.0))
    return out


#: Class of each byte: 0 none, 1 lower, 2 upper, 3 digit, 4 part of a longer character; marks keep their own code.
_CLASS = np.array([1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b >= 128 else b + 5 for b in range(256)], np.int64)


def shapes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shape slot, bytes) of each word: classes of its first two and last two bytes, hashed to SHAPES slots."""
    words = words.cast(pa.large_string())
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] and words.buffers()[2].size else np.zeros(1, np.uint8)
    start, end = offsets[:-1], offsets[1:]
    n = end - start
    at = lambda i, ok: np.where(ok, _CLASS[data[np.clip(i, 0, len(data) - 1)]], 0)
    code = ((at(start, n > 0) * 131 + at(start + 1, n > 1)) * 131 + at(end - 2, n > 2)) * 131 + at(end - 1, n > 1)
    mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(52)).astype(np.int64) % SHAPES, n


@dataclass
class Vectors:
    vocabulary: pa.Array
    words: np.ndarray
    shapes: np.ndarray


def pooled(texts: pa.Array, vectors: Vectors) -> np.ndarray:
    """One row of 2 * DIM + 6 numbers for each text without nulls; a text without words is all zero."""
    out = np.zeros((len(texts), 2 * DIM + _RATIOS), np.float32)
    docs, codes, distinct = words_of(texts)
    if not len(docs):
        return out
    known = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=vectors.vocabulary), -1))
    shape, n_bytes = shapes(distinct)
    present, first, n = np.unique(docs, return_index=True, return_counts=True)
    word = known[codes]
    rows = np.where((word >= 0)[:, None], vectors.words[np.maximum(word, 0)], np.float32(0))
    seen = np.add.reduceat((word >= 0).astype(np.float32), first)
    out[present, :DIM] = np.add.reduceat(rows, first) / np.maximum(seen, 1)[:, None]
    out[present, DIM : 2 * DIM] = np.add.reduceat(vectors.shapes[shape[codes]], first) / n[:, None]
    pairs = np.unique(docs * np.int64(len(distinct)) + codes) // len(distinct)
    size = np.add.reduceat(n_bytes[codes].astype(np.float64), first)
    out[present, 2 * DIM :] = np.stack([seen / n, np.bincount(pairs, minlength=len(texts))[present] / n, np.log1p(n) / 5, size / n / 10, np.minimum(n, 20) / 20, np.ones(len(n))], axis=1)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on four fifths of the rows, the epoch with the least loss on the last fifth, then its temperature there."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    order = rng.permutation(len(x))
    held, rest = order[: len(x) // 5], order[len(x) // 5 :]
    if not len(held):
        held = rest
    net = Network(x[rest].mean(0), x[rest].std(0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step, best = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, (np.inf, None)

    def loss(p: list[np.ndarray], rows: np.ndarray, t: float = 1.0) -> float:
        logit = (np.tanh(z[rows] @ p[0] + p[1]) @ p[2] + p[3][0]) / t
        return float(np.mean(np.logaddexp(0, np.where(y[rows] > 0, -logit, logit))))

    for _ in range(EPOCHS):
        rng.shuffle(rest)
        for at in range(0, len(rest), BATCH):
            rows = rest[at : at + BATCH]
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back + DECAY * params[0], back.sum(0), hidden.T @ error + DECAY * params[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        now = loss(params, held)
        if now < best[0]:
            best = (now, [p.copy() for p in params])
    p = best[1]
    temperature = min(np.geomspace(0.5, 8, 57), key=lambda t: loss(p, held, t))
    return Network(net.mean, net.scale, p[0], p[1], p[2], float(p[3][0]), float(temperature))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in slabs(batch.column("text"), _SLAB):
            docs, codes, distinct = words_of(texts)
            pairs = np.unique(docs * np.int64(max(1, len(distinct))) + codes) % max(1, len(distinct))
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(np.bincount(pairs, minlength=len(distinct)).astype(np.int64))], ["word", "n"])


def _context_sums(vocabulary: pa.Array):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(vocabulary) + SHAPES, DIM), np.float64)
        shape_index = index_vectors(np.arange(SHAPES, dtype=np.uint64) + np.uint64(1 << 40))
        for batch in batches:
            for _, texts in slabs(batch.column("text"), _SLAB):
                docs, codes, distinct = words_of(texts)
                if not len(docs):
                    continue
                known = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1))
                shape, _ = shapes(distinct)
                index = (index_vectors(word_hashes(distinct)) * (known >= 0)[:, None] + shape_index[shape])[codes]
                around = np.zeros_like(index)
                for d in range(1, WINDOW + 1):
                    same = (docs[d:] == docs[:-d])[:, None]
                    around[d:] += index[:-d] * same
                    around[:-d] += index[d:] * same
                for keys in (known[codes], len(vocabulary) + shape[codes]):
                    order = np.argsort(keys, kind="stable")
                    sorted_ = keys[order]
                    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
                    sums = np.add.reduceat(around[order], first)
                    ok = sorted_[first] >= 0
                    total[sorted_[first][ok]] += sums[ok]
        used = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, k]) for k in range(DIM))], ["slot", *(f"v{k}" for k in range(DIM))])

    return step


def _features(vectors: Vectors):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slabs(batch.column("text"), _SLAB):
                x = pooled(texts, vectors)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(start, len(texts)), pa.array(x.tolist(), pa.list_(pa.float32()))], ["y", "x"])

    return step


@dataclass
class Model:
    vectors: Vectors | None
    network: Network | None
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        return self.network.probabilities(pooled(texts, self.vectors))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y): up to ``rows`` labelled rows that aren't held out, those with the least hash of their id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """A model from at most ``rows`` labelled rows; without both labels among them it is their share, 0.5 for none."""
    sample = materialise(labelled_sample(docs, labels, label, rows).repartition(8, "doc_id"), "quality-sample").coalesce(8)
    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(None, None, 0.5 if not counts else float(next(iter(counts))))
    words = sample.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    vocabulary = pa.array([r["word"] for r in words.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()], pa.large_string())
    total = np.zeros((len(vocabulary) + SHAPES, DIM))
    parts = sample.select("text").mapInArrow(_context_sums(vocabulary), "slot bigint, " + ", ".join(f"v{k} double" for k in range(DIM)))
    sums = parts.groupBy("slot").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM))).toPandas()
    total[sums["slot"].to_numpy()] = sums[[f"v{k}" for k in range(DIM)]].to_numpy()
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    words_ = np.concatenate([total[: len(vocabulary)], np.zeros((1, DIM))])  # a row to look at where there is no vocabulary
    vectors = Vectors(vocabulary, words_.astype(np.float32), total[len(vocabulary) :].astype(np.float32))
    got = sample.select("y", "text").mapInArrow(_features(vectors), "y int, x array<float>").toPandas()
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort((got["y"].to_numpy(), *x.T[::-1]))
    return Model(vectors, train_network(x[order], got["y"].to_numpy(float)[order]), counts.get(1, 0) / sum(counts.values()))


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with column ``out``; null, empty and blank texts get the score of a text without words."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(texts) for _, texts in slabs(batch.column(text), _SLAB)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, out])

    narrow = docs.select(*[F.col(f"`{c}`") for c in kept])
    return narrow.mapInArrow(freeing(step), StructType([*narrow.schema.fields, StructField(out, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null, empty and blank texts score alike; very long ones are read whole; ids may be null, of any type, or repeat,
    and repeated rows come as often as they are given; other columns aren't read. An empty table gives an empty
    result. A score of exactly ``accept`` is accepted. Of several labels of one id the greatest counts.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, label)).select("doc_id", "score")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
