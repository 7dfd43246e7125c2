"""Document quality by random indexing: word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every word bucket has a sparse random index vector; its context vector is the sum of its neighbours' index vectors in the labelled
sample. The same is done for word shapes (first and last characters by class), so that unseen words still say something.
A document is the mean of its words' and shapes' vectors together with how concentrated and how repetitive it is. The
network and the temperature are fitted in NumPy on a bounded labelled sample; scores cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import words as W
from panelkit.llm.sampling import excerpts, labelled_sample, order

BUCKETS = 1 << 14
DIMENSIONS = 64
NONZERO = 6
REACH = 2
#: Bounds of the sample: labelled documents of each class, and excerpts of a document that word vectors are learned from.
DOCS_PER_LABEL = 2000
EXCERPTS, EXCERPT_CHARS = 2, 800
HIDDEN = 32
EPOCHS = 80
SEED = 29
BLOCK = 1 << 14

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 4


@dataclass
class Vectors:
    words: np.ndarray
    shapes: np.ndarray


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((features - self.mean) / self.scale) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def __call__(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(features) / self.temperature, -50, 50)))


def _buckets(piece: W.Piece) -> tuple[W.Words, np.ndarray, np.ndarray]:
    own = W.split(piece)
    value = W.hashes(piece.data, own)
    kind = _CLASS[piece.data]
    last = own.ends - 1
    shape = np.zeros(len(value), np.uint64)
    with np.errstate(over="ignore"):
        for place in (own.starts, np.maximum(last - 2, own.starts), np.maximum(last - 1, own.starts), last):
            shape = shape * np.uint64(1_000_003) + kind[place]
    return own, (value % np.uint64(BUCKETS)).astype(np.int64), (W.mix(shape) % np.uint64(BUCKETS)).astype(np.int64)


def index_vectors(seed: int) -> np.ndarray:
    """Sparse ternary vectors, one for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    place = rng.random((BUCKETS, DIMENSIONS)).argpartition(NONZERO, 1)[:, :NONZERO]
    out[np.arange(BUCKETS)[:, None], place] = rng.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO))
    return out


def learn_vectors(texts: list[str], seed: int = SEED) -> Vectors:
    """Index vectors plus normalised sums of the index vectors of neighbours up to ``REACH`` words away."""
    index = [index_vectors(seed), index_vectors(seed + 1)]
    context = [np.zeros_like(x) for x in index]
    for piece in W.pieces(pa.array(texts, pa.string())):
        own, *ids = _buckets(piece)
        for step in range(1, REACH + 1):
            near = np.flatnonzero(own.text[:-step] == own.text[step:]) if len(own.text) > step else np.zeros(0, int)
            for k in (0, 1):
                np.add.at(context[k], ids[k][near], index[k][ids[k][near + step]])
                np.add.at(context[k], ids[k][near + step], index[k][ids[k][near]])
    for k in (0, 1):
        index[k] /= np.sqrt(NONZERO)
        index[k] += context[k] / np.maximum(np.linalg.norm(context[k], axis=1, keepdims=True), 1e-6)
    return Vectors(*index)


def _pooled(table: np.ndarray, ids: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Sum of table rows by text; words go by in blocks, so a long text needs no more memory than a short one."""
    out = np.zeros((texts, table.shape[1]))
    for at in range(0, len(ids), BLOCK):
        own = text[at : at + BLOCK]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[start]] += np.add.reduceat(table[ids[at : at + BLOCK]], start, axis=0)
    return out


def features(vectors: Vectors, column: pa.Array) -> np.ndarray:
    """One row per text. A text without words has zeros."""
    rows = []
    for piece in W.pieces(column):
        own, word, shape = _buckets(piece)
        n = np.diff(own.bounds)
        some = np.maximum(n, 1)[:, None]
        a = _pooled(vectors.words, word, own.text, len(piece)) / some
        b = _pooled(vectors.shapes, shape, own.text, len(piece)) / some
        if len(word) > 1:
            again = (word[1:] == word[:-1]) & (own.text[1:] == own.text[:-1])
            repeats = np.bincount(own.text[1:][again], minlength=len(piece))
            key = np.unique(own.text * BUCKETS + word)
            distinct = np.bincount(key // BUCKETS, minlength=len(piece))
        else:
            repeats, distinct = np.zeros(len(piece)), np.minimum(n, 1)
        size = some[:, 0]
        extra = [(a * a).sum(1), (b * b).sum(1), np.log1p(n), repeats / size, distinct / size, np.log1p(distinct)]
        rows.append(np.concatenate([a, b, np.stack(extra, 1)], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 2 * DIMENSIONS + 6))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = SEED) -> Network:
    """Adam on weighted cross entropy; the temperature minimises it on a fifth of the rows that the network does not see."""
    rng = np.random.default_rng(seed)
    size = x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(size), np.ones(size))
    share = float(np.average(y, weights=weight)) if len(x) else 0.5
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    net = Network(mean, scale, rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), prior, 1.0)
    if len(np.unique(y)) < 2:
        net.second[:] = 0
        return net
    place = rng.permutation(len(x))
    held, own = place[: len(x) // 5], place[len(x) // 5 :]
    parts = [net.first, net.first_bias, net.second, np.array([prior])]
    moment, square, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    z = (x - mean) / scale
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
            step += 1
            hidden = np.tanh(z[rows] @ parts[0] + parts[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ parts[2] + parts[3], -50, 50)))
            back = weight[rows] * (p - y[rows]) / len(rows)
            inner = back[:, None] * parts[2] * (1 - hidden**2)
            grads = [z[rows].T @ inner + 1e-4 * parts[0], inner.sum(0), hidden.T @ back + 1e-4 * parts[2], np.array([back.sum()])]
            for part, grad, m, v in zip(parts, grads, moment, square, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                part -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    net.second_bias = float(parts[3][0])
    raw = net.logits(x[held])

    def loss(temperature: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(raw / temperature, -50, 50))), 1e-9, 1 - 1e-9)
        return float(-(weight[held] * np.where(y[held] == 1, np.log(p), np.log(1 - p))).sum())

    if len(held):
        net.temperature = min(np.geomspace(0.5, 8, 41), key=loss)
    return net


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[Vectors, Network]:
    """Fit on at most ``DOCS_PER_LABEL`` documents of each class (0 and 1). Null labels, ids and texts are left out; of several labels of a document the smallest counts."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    sample = F.broadcast(labelled_sample(rows, key, "label", DOCS_PER_LABEL, SEED))  # 2 * DOCS_PER_LABEL rows at most
    chosen = docs.where(F.col(text).isNotNull()).select(key, text).join(sample, key)
    cut = chosen.select(F.explode(F.array_distinct(excerpts(text, key, EXCERPTS, EXCERPT_CHARS, SEED))).alias("cut")).where("cut <> ''")
    vectors = learn_vectors(sorted(r["cut"] for r in cut.collect()))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(shared.value, batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(list(found), pa.list_(pa.float64()))], ["place", "label", "x"])

    seen = chosen.select(order(key, SEED).alias("place"), text, F.col("label").cast("int").alias("label")).mapInArrow(
        measure, "place long, label int, x array<double>").collect()
    seen.sort(key=lambda r: (r["place"], r["x"]))
    x = np.array([r["x"] for r in seen]).reshape(len(seen), 2 * DIMENSIONS + 6)
    y = np.array([r["label"] for r in seen], int)
    per = np.maximum(np.bincount(y, minlength=2), 1)
    weight = np.array([counts.get(k, 0) / per[k] for k in (0, 1)])[y] if len(y) else np.zeros(0)
    return vectors, train(x, y, weight / weight.mean() if len(y) else weight)


def score(docs: DataFrame, model: tuple[Vectors, Network], text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1. Null and empty texts are scored as texts without words.

    A model fitted on rows of one class, or none, gives every text that class's share (0.5). Rows may repeat. An input column called
    ``score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(column: pa.Array) -> pa.Array:
        vectors, network = shared.value
        return pa.array(network(features(vectors, column)), pa.float64())

    return docs.drop("score").withColumn("score", probability.asNondeterministic()(F.col(text)))
