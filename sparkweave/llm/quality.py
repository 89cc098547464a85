"""Quality of texts by attention over their passages: gated attention-based multiple-instance learning in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, prefix_hash, runs, span_hash, text_bytes, with_columns, word_spans
from .training import Adam, fitted, sampled, sigmoid, texts_and_labels

#: Words of a passage; the last of a text may have fewer.
PASSAGE = 64
PAIRS = 256
SHAPES = 9
HIDDEN = 24
ATTENTION = 12
#: Labelled rows of each class that the model learns from, at most.
PER_CLASS = 2000
EPOCHS = 12
THRESHOLD = 0.7
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"]] = True


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature vector of every passage of every text; a text without words is one passage of zeros.

    A vector holds the square roots of the shares of hashed byte pairs, and the passage's shapes: word length, shares
    of symbols, capitals, digits, other bytes, words without letters, distinct words, words like the one before, size.
    """
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    rows, out = [], []
    for a, b in runs(offsets):
        raw = data[offsets[a] : offsets[b]]
        bounds = offsets[a : b + 1] - offsets[a]
        starts, ends, row = word_spans(raw, bounds)
        counts = np.bincount(row, minlength=b - a)
        per_row = np.maximum(-(-counts // PASSAGE), 1)
        before = np.cumsum(per_row) - per_row
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        passage = before[row] + place // PASSAGE
        total = int(per_row.sum())
        x = np.zeros((total, PAIRS + SHAPES), np.float32)
        if len(row):
            size = np.bincount(passage, minlength=total)
            lengths = ends - starts
            at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            owner = np.repeat(passage, lengths)
            low = LOWER[raw]
            nxt = np.r_[low[1:], 32][at]
            pair = ((low[at].astype(np.int64) * 131 + nxt) * 40503 >> 8) % PAIRS
            n_bytes = np.maximum(np.bincount(owner, minlength=total), 1)
            x[:, :PAIRS] = np.sqrt(np.bincount(owner * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS) / n_bytes[:, None])
            byte = raw[at]
            letter = (((byte | 32) >= 97) & ((byte | 32) <= 122)) | (byte > 127)
            capital = (byte >= 65) & (byte <= 90)
            shares = [np.bincount(owner[k], minlength=total) / n_bytes for k in (_SYMBOL[byte], capital, (byte >= 48) & (byte <= 57), byte > 127)]
            has_letter = np.add.reduceat(letter, np.cumsum(lengths) - lengths) > 0
            words = span_hash(prefix_hash(raw), starts, ends)
            order = np.lexsort((words, passage))
            new = np.r_[True, (words[order][1:] != words[order][:-1]) | (passage[order][1:] != passage[order][:-1])]
            distinct = np.bincount(passage[order][new], minlength=total)
            like = np.r_[False, (words[1:] == words[:-1]) & (row[1:] == row[:-1])]
            most = np.maximum(size, 1)
            shapes = [n_bytes / most / 10, *shares, np.bincount(passage[~has_letter], minlength=total) / most, distinct / most, np.bincount(passage[like], minlength=total) / most, np.log1p(size) / 5]
            x[:, PAIRS:] = np.where(size[:, None] > 0, np.stack(shapes, 1), 0)
        rows.append(np.repeat(np.arange(a, b), per_row))
        out.append(x)
    if not out:
        return np.zeros(0, np.int64), np.zeros((0, PAIRS + SHAPES), np.float32)
    assert rows[-1][-1] == n - 1
    return np.concatenate(rows), np.concatenate(out)


def _forward(model: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, row: np.ndarray):
    h = np.tanh((x - model["mean"]) * model["scale"] @ model["W"] + model["b"])
    u, g = np.tanh(h @ model["V"]), sigmoid(h @ model["U"])
    e = (u * g) @ model["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[row])
    weight = e / np.add.reduceat(e, first)[row]
    z = np.add.reduceat(weight[:, None] * h, first, axis=0)
    return h, u, g, weight, z, z @ model["c"] + model["d"][0]


def train(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, batch: int = 256) -> dict[str, np.ndarray]:
    """Encoder, gated attention and output weights, learned from the texts' labels alone; classes weigh alike."""
    rng = np.random.default_rng(seed)
    size = PAIRS + SHAPES
    model = {"mean": np.zeros(size, np.float32), "scale": np.ones(size, np.float32), "b": np.zeros(HIDDEN), "w": rng.normal(0, 0.3, ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    model |= {"W": rng.normal(0, 0.06, (size, HIDDEN)), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION))}
    if not len(labels):
        return model
    if labels.min() == labels.max():
        return model | {"d": np.array([40.0 if labels[0] else -40.0])}
    row, x = passages(texts)
    model["mean"], model["scale"] = x.mean(0), 1 / (x.std(0) + 0.02)
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum())) * len(labels)
    start = np.searchsorted(row, np.arange(len(labels) + 1))
    learned = {k: model[k] for k in "WbVUwcd"}
    adam = Adam(learned, 0.005)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            sizes = start[own + 1] - start[own]
            first = np.cumsum(sizes) - sizes
            at = np.repeat(start[own] - first, sizes) + np.arange(int(sizes.sum()))
            bag = np.repeat(np.arange(len(own)), sizes)
            part = x[at]
            h, u, g, weight, z, logit = _forward(model, part, first, bag)
            delta = (sigmoid(logit) - labels[own]) * share[own] / len(own)
            dz = delta[:, None] * model["c"]
            dweight = (dz[bag] * h).sum(1)
            de = weight * (dweight - np.add.reduceat(weight * dweight, first)[bag])
            dug = de[:, None] * model["w"]
            du, dg = dug * g * (1 - u * u), dug * u * g * (1 - g)
            dh = weight[:, None] * dz[bag] + du @ model["V"].T + dg @ model["U"].T
            dpre = dh * (1 - h * h)
            scaled = (part - model["mean"]) * model["scale"]
            adam.step({"W": scaled.T @ dpre + 1e-4 * model["W"], "b": dpre.sum(0), "V": h.T @ du, "U": h.T @ dg, "w": (u * g).T @ de, "c": z.T @ delta + 1e-4 * model["c"], "d": np.array([delta.sum()])})
    return model


def score_texts(texts: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    out = np.zeros(len(texts))
    _, offsets = text_bytes(texts)
    for a, b in runs(offsets):
        row, x = passages(texts.slice(a, b - a))
        first = np.searchsorted(row, np.arange(b - a))
        out[a:b] = sigmoid(_forward(model, x, first, row)[-1])
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 4, held_out: int = 2) -> dict[str, np.ndarray]:
    """The model from up to per_class labelled documents of each class outside the held-out fold."""
    return fitted(sampled(docs, labels, "quality", folds, held_out, per_class), lambda table: train(*texts_and_labels(table)))


def score(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs, and score (0 to 1) and predicted (1 if score >= threshold).

    One pass, no shuffle; the model, of fixed size, is broadcast. Null and empty texts count as one passage of zeros.
    Repeated rows each get their row, an empty table none. Columns of docs by the new names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def body(batch: pa.RecordBatch) -> list[pa.Array]:
        s = score_texts(batch.column("text"), held.value)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return with_columns(docs, "score double, predicted int", body)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() % 4 == 2, F.lit(False)).alias("held_out"), "score", "predicted")
