"""Toxicity of texts: averaged embeddings of subword bags under a linear softmax, learned jointly in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, fold, kept_rows, runs, text_bytes, with_columns
from .subwords import means, words_of
from .training import Adam, fitted, sampled, sigmoid, texts_and_labels

LENGTHS = (4, 5)
BUCKETS = 1 << 16
DIMENSIONS = 8
#: Labelled rows of each class that the model learns from, at most.
PER_CLASS = 2000
STEPS = 240
#: Texts of the sample that a subword must occur in to have an embedding; one seen in fewer adds nothing to a score.
MIN_TEXTS = 5
#: Empty words that every text is taken to end in, so that few words are no proof.
PADDING = 10
THRESHOLD = 0.7


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and weight of every subword; a text's words count alike, and a word's n-grams."""
    data, offsets = text_bytes(texts)
    out = []
    for a, b in runs(offsets, CHUNK_BYTES // 2):
        words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        owner, bucket = words.ngrams(LENGTHS, BUCKETS)
        first = np.searchsorted(owner, np.arange(len(words.hashes) + 1))
        share = 1 / np.diff(first)
        # a word that occurs several times in a text comes once, with its count
        pair, count = np.unique(words.row * len(words.hashes) + words.word, return_counts=True)
        row, word = np.divmod(pair, max(1, len(words.hashes)))
        n_words = np.bincount(words.row, minlength=b - a)
        size = np.diff(first)[word]
        at = np.repeat(first[:-1][word] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
        key = np.repeat(row, size) * BUCKETS + bucket[at]
        key, back = np.unique(key, return_inverse=True)
        weight = np.bincount(back, np.repeat(count * share[word] / (n_words[row] + PADDING), size), len(key))
        out.append(((key // BUCKETS + a).astype(np.int32), (key % BUCKETS).astype(np.int32), weight.astype(np.float32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))


def train(texts: pa.Array, labels: np.ndarray, steps: int = STEPS, seed: int = 3, rate: float = 0.2, min_texts: int = MIN_TEXTS) -> dict[str, np.ndarray]:
    """Embeddings E, softmax weights W and biases b. Both classes weigh alike. Without rows of a class all scores are 0."""
    rng = np.random.default_rng(seed)
    model = {"E": rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)), "W": rng.normal(0, 0.5, (DIMENSIONS, 2)), "b": np.zeros(2)}
    n = len(labels)
    if not n or labels.min() == labels.max():
        return {k: np.zeros_like(v) for k, v in model.items()} | {"b": np.array([40.0, -40.0])}
    row, bucket, weight = bags(texts)
    known = np.bincount(bucket, minlength=BUCKETS) >= min_texts
    model["E"][~known] = 0  # a subword that was hardly seen says nothing
    keep = known[bucket]
    row, bucket, weight = row[keep], bucket[keep], weight[keep]
    del keep
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))
    truth = np.eye(2)[labels]
    adam = Adam(model, rate, whole=("E",))
    for _ in range(steps):
        odds, bias = folded(model)
        logit = np.zeros(n)
        logit[row[first]] = np.add.reduceat(weight * odds[bucket], first) + bias if len(first) else 0
        delta = (sigmoid(logit) - truth[:, 1]) * share  # of class 1; of class 0 it is the opposite
        back = np.bincount(bucket, weight * delta[row].astype(np.float32), BUCKETS)
        back = np.stack([-back, back], 1)
        adam.step({"E": back @ model["W"].T, "W": model["E"].T @ back, "b": np.array([-delta.sum(), delta.sum()])})
    return model


def folded(model: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
    """What a bucket adds to the log-odds, and the bias: the same model, as means and products commute."""
    return (model["E"] @ (model["W"][:, 1] - model["W"][:, 0])).astype(np.float32), float(model["b"][1] - model["b"][0])


def score_texts(texts: pa.Array, odds: np.ndarray, bias: float) -> np.ndarray:
    data, offsets = text_bytes(texts)
    out = np.zeros(len(offsets) - 1)
    for a, b in runs(offsets, CHUNK_BYTES // 2):
        words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        owner, bucket = words.ngrams(LENGTHS, BUCKETS)
        each = means(odds[bucket], owner, len(words.hashes))
        out[a:b] = np.bincount(words.row, each[words.word], b - a) / (np.bincount(words.row, minlength=b - a) + PADDING)
    return sigmoid(out + bias)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 3, held_out: int = 1, min_texts: int = MIN_TEXTS) -> tuple[np.ndarray, float]:
    """The folded model from up to per_class labelled documents of each class outside the held-out fold."""

    def learn(table: pa.Table):
        return folded(train(*texts_and_labels(table), min_texts=min_texts))

    return fitted(sampled(docs, labels, "toxic", folds, held_out, per_class), learn)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs, and score (0 to 1) and predicted (1 if score >= threshold).

    One pass, no shuffle; the model, of fixed size, is broadcast. A null or empty text has no words and the score of
    the bias alone. Repeated rows each get their row, an empty table none. Columns of docs by these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def body(batch: pa.RecordBatch) -> list[pa.Array]:
        s = score_texts(batch.column("text"), *held.value)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return with_columns(docs, "score double, predicted int", body)


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under threshold, with the columns of docs, whatever their names; see score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, lambda batch: score_texts(batch.column("text"), *held.value) < threshold)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")
