"""Bounded labelled samples, and the fitting of models on them in a task of its own."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def sampled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of up to per_class documents of each class outside the held-out fold.

    Of each class the first ids by a hash are taken. Labels other than 0 and 1, null ids and ids with both labels are
    left out; a repeated id counts once, with its least text, and ids that no document has are none. The chosen ids, two
    per_class at most, are broadcast to the scan of the texts.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold() % folds != held_out))
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = high")
    first = [one.where(F.col("low") == k).select("doc_id", F.col("low").cast("long").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(first[0].union(first[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def fitted(sample: DataFrame, learn: Callable[[pa.Table], object]) -> object:
    """What learn makes of a bounded sample, in one task on an executor: the driver gets the model alone, never the rows."""
    schema = pa.schema([(f.name, pa.string() if f.dataType.simpleString() == "string" else pa.int64()) for f in sample.schema.fields])

    def body(batches):
        held = [b.cast(schema) for b in batches]
        yield pa.record_batch({"model": pa.array([pickle.dumps(learn(pa.Table.from_batches(held, schema)))], pa.binary())})

    rows = sample.repartition(1).mapInArrow(body, "model binary").collect()
    return pickle.loads(rows[0][0]) if rows else learn(schema.empty_table())


def texts_and_labels(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of a sample, in order of id."""
    table = table.sort_by("doc_id")
    texts = pa.array([], pa.string()) if not table.num_rows else pa.concat_arrays(table["text"].chunks)
    return texts, table["label"].to_numpy().astype(np.int64)


class Adam:
    """Adam over a dict of arrays, changed in place; those named in whole share one second moment, the mean of theirs."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, whole: tuple[str, ...] = ()):
        self.weights, self.rate, self.whole, self.t = weights, rate, whole, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in gradients.items():
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * (np.mean(g * g) if k in self.whole else g * g)
            self.weights[k] -= rate * m / (np.sqrt(v) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
