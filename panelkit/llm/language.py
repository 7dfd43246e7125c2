"""Language identification by a convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes. Filters of several widths run over a window's bytes, each filter keeps its largest
answer, and a linear layer with softmax turns these into languages; a text's logits are the mean of its windows', weighted by bytes.
The network is trained in NumPy on a bounded labelled sample and applied to all windows of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm import words as W
from panelkit.llm.sampling import excerpts, labelled_sample

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the training sample: documents of a language, and excerpts of a document.
DOCS_PER_LANGUAGE = 500
EXCERPTS = 4
SEED = 17
EPOCHS = 6
BATCH = 64
CHUNK = 128

UNKNOWN = "und"


@dataclass
class Model:
    """``filters[w]`` is width x 256 x FILTERS; ``languages`` may be empty, then nothing is known."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def _windows(piece: W.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows, the text of each and the bytes in each."""
    size = np.diff(piece.offsets)
    count = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1] * WINDOW, np.uint8)
    out[np.arange(len(piece.data)) + np.repeat(first[:-1] * WINDOW - piece.offsets[:-1], size)] = piece.data
    text = np.repeat(np.arange(len(piece)), count)
    used = np.minimum(size[text] - (np.arange(first[-1]) - first[text]) * WINDOW, WINDOW)
    return out.reshape(-1, WINDOW), text, used


def _answers(filters: np.ndarray, window: np.ndarray) -> np.ndarray:
    width = len(filters)
    n = window.shape[1] - width + 1
    return sum(filters[k][window[:, k : k + n]] for k in range(width))


def train(texts: list[str], labels: list[str], seed: int = SEED) -> Model:
    """Adam on the cross entropy of single windows; languages weigh the same however many windows they have."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    filters = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
    weights = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(languages)))).astype(np.float32)
    offset = np.zeros(max(1, len(languages)), np.float32)
    model = Model(languages, filters, bias, weights, offset)
    if len(languages) < 2:
        return model
    each, target = [], []
    for text, label in zip(texts, labels, strict=True):
        data = text.encode()
        if not data:
            continue
        if rng.random() < 0.25:  # short texts have short windows
            data = data[: int(rng.integers(8, 120))]
        row = np.zeros(WINDOW, np.uint8)
        row[: min(len(data), WINDOW)] = np.frombuffer(data[:WINDOW], np.uint8)
        each.append(row)
        target.append(languages.index(label))
    x, y = np.array(each), np.array(target)
    share = 1.0 / np.maximum(np.bincount(y, minlength=len(languages)), 1)
    importance = (share * len(y) / len(languages)).astype(np.float32)
    parts = [*filters.values(), bias, weights, offset]
    moment, square, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            step += 1
            window, pooled, where = x[rows], [], []
            for own in filters.values():
                found = _answers(own, window)
                at = found.argmax(1)
                where.append(at)
                pooled.append(np.take_along_axis(found, at[:, None], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + bias
            hidden = np.maximum(raw, 0)
            logits = hidden @ weights + offset
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (importance[y[rows]] / len(rows))[:, None]
            back = (p @ weights.T) * (raw > 0)
            grads = []
            for j, (width, own) in enumerate(filters.items()):
                grad, mine = np.zeros_like(own), back[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(width):
                    byte = np.take_along_axis(window, where[j] + k, 1)
                    np.add.at(grad[k], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), mine)
                grads.append(grad)
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            rate = 0.01 * (1 - 0.8 * epoch / EPOCHS)
            for part, grad, m, v in zip(parts, grads, moment, square, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model


class Predictor:
    """A model with its filters summed into tables over byte pairs: a width-4 filter is two look-ups."""

    def __init__(self, model: Model):
        self.model = model
        pair = np.arange(65536)
        high, low = pair >> 8, pair & 255  # first and second byte
        two, three, four = (model.filters[w] for w in WIDTHS)
        self.table = np.concatenate([two[0][high] + two[1][low], three[0][high] + three[1][low],
                                     four[0][high] + four[1][low], four[2][high] + four[3][low]], 1)
        self.third = three[2]

    def logits(self, window: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(window), CHUNK):
            own = window[at : at + CHUNK]
            rows = np.take(self.table, (own[:, :-1].astype(np.uint16) << 8) | own[:, 1:], axis=0)
            pooled = [rows[:, :, :FILTERS].max(1), (rows[:, :-1, FILTERS : 2 * FILTERS] + self.third[own[:, 2:]]).max(1),
                      (rows[:, :-2, 2 * FILTERS : 3 * FILTERS] + rows[:, 2:, 3 * FILTERS :]).max(1)]
            out.append(np.maximum(np.concatenate(pooled, 1) + self.model.bias, 0) @ self.model.weights + self.model.offset)
        return np.concatenate(out) if out else np.zeros((0, len(self.model.offset)))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language number and probability of each text."""
        best, score = [], []
        for piece in W.pieces(column):
            window, text, used = _windows(piece)
            weight = used / np.maximum(np.bincount(text, used, len(piece)), 1)[text]
            own = self.logits(window) * weight[:, None]
            total = np.stack([np.bincount(text, own[:, k], len(piece)) for k in range(own.shape[1])], 1)
            p = np.exp(total - total.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best.append(p.argmax(1))
            score.append(p.max(1))
        return np.concatenate(best), np.concatenate(score)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """Train on at most about ``DOCS_PER_LANGUAGE`` documents of each language, ``EXCERPTS`` windows from each. Null labels and texts are left out."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, text, F.col(label).cast("string").alias("label"))
    sample = labelled_sample(rows, key, "label", DOCS_PER_LANGUAGE, SEED)
    cut = excerpts(text, key, EXCERPTS, WINDOW, SEED)
    found = sample.select(F.explode(F.array_distinct(cut)).alias("cut"), "label").where("cut <> ''").collect()
    found.sort()
    return train([r["cut"] for r in found], [r["label"] for r in found])


def predictions(model: Model, text: str) -> Column:
    """``struct<lang_pred, score>`` of a text column."""
    shared: list[Predictor] = []
    known = np.array([*model.languages, UNKNOWN])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(column: pa.Array) -> pa.Array:
        if not shared:
            shared.append(Predictor(model))
        best, score = shared[0](column) if len(column) else (np.zeros(0, int), np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(known[best], pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict.asNondeterministic()(F.col(text))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the language's probability).

    A text that is null or has no letter is ``und`` with score 0. A model that knows one language always answers that language; one
    that knows none answers ``und`` with score 0. Input columns called like a result column are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if model.languages else F.lit(False)
    found = docs.withColumn("__found", predictions(model, text)).withColumn("__lettered", lettered)
    return found.select(
        *docs.columns, F.when(F.col("__lettered"), F.col("__found.lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("__lettered"), F.col("__found.score")).otherwise(F.lit(0.0)).alias("score"))
