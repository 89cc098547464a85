"""Languages of texts by a linear-chain conditional random field over their words, learned in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, fold, runs, text_bytes, with_columns
from .subwords import words_of
from .training import Adam, fitted

#: n-grams of <word>: those with < or > are its affixes, the others lie inside; the whole word is the lexicon's feature.
LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Words of the chains that the model learns from. A text to be labelled is one chain, whatever its length, worked out
#: in segments of so many words.
CHAIN = 32
#: Documents of each language that the model learns from, at most.
PER_LANGUAGE = 150
STEPS = 30
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    emission: np.ndarray  # of each feature bucket for each language
    transition: np.ndarray  # from language to language
    start: np.ndarray


def chains(row: np.ndarray, n_rows: int, length: int = CHAIN) -> tuple[np.ndarray, np.ndarray, int]:
    """Chain and place in it of each word, given the row of each, rows ascending."""
    counts = np.bincount(row, minlength=n_rows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    per_row = -(-counts // length)
    return (np.cumsum(per_row) - per_row)[row] + place // length, place % length, int(per_row.sum())


def forward_backward(unary: np.ndarray, real: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of each place, sums of pair marginals, and the log of each chain's partition sum.

    unary: chains x places x labels; real: whether a place holds a word; the words of a chain come first.
    """
    s, t, k = unary.shape
    top = unary.max(2, initial=0)
    emit = np.exp(unary - top[:, :, None])
    move = np.exp(transition)
    ahead, back = np.empty((t, s, k)), np.ones((t, s, k))
    a = emit[:, 0] * np.exp(start)
    total = a.sum(1)
    log_z = np.log(total) + top[:, 0]
    ahead[0] = a / total[:, None]
    for i in range(1, t):
        a = (ahead[i - 1] @ move) * emit[:, i]
        total = a.sum(1)
        on = real[:, i]
        ahead[i] = np.where(on[:, None], a / total[:, None], ahead[i - 1])
        log_z += np.where(on, np.log(total) + top[:, i], 0)
    pairs = np.zeros((k, k))
    for i in range(t - 1, 0, -1):
        on = real[:, i]
        later = emit[:, i] * back[i]
        b = later @ move.T
        joint = (ahead[i - 1] * b).sum(1)
        left = np.where(on[:, None], ahead[i - 1] / joint[:, None], 0)
        pairs += (left.T @ later) * move
        back[i - 1] = np.where(on[:, None], b / b.sum(1, keepdims=True), back[i])
    marginal = ahead * back
    marginal /= marginal.sum(2, keepdims=True)
    return marginal.transpose(1, 0, 2), pairs, log_z


def word_scores(words, emission: np.ndarray) -> np.ndarray:
    """Emission score of every distinct word for every language: the mean weight of its features, times their kinds."""
    owner, bucket = words.ngrams(LENGTHS, BUCKETS)
    n = len(words.hashes)
    if not n:
        return np.zeros((0, emission.shape[1]))
    first = np.searchsorted(owner, np.arange(n))
    return np.add.reduceat(emission[bucket], first, axis=0)


def train(texts: pa.Array, languages: list[str], steps: int = STEPS, seed: int = 5) -> Model:
    """Fit by the likelihood of chains whose words carry their text's language.

    Every second chain is made code-switched: its tail is that of another chain, so that transitions are learned too.
    """
    known = sorted(set(languages))
    k = len(known)
    model = {"emission": np.zeros((BUCKETS, k)), "transition": np.eye(k), "start": np.zeros(k)}
    data, offsets = text_bytes(texts)
    words = words_of(data, offsets, letters_only=True)
    if k < 2 or not len(words.row):
        return Model(known, **model)
    label = np.searchsorted(known, np.array(languages))
    chain, place, n = chains(words.row, len(languages))
    word = np.full((n, CHAIN), -1, np.int64)
    word[chain, place] = words.word
    truth = np.full((n, CHAIN), -1, np.int64)
    truth[chain, place] = label[words.row]
    rng = np.random.default_rng(seed)
    switched, other = np.arange(0, n, 2), rng.permutation(n)[: len(range(0, n, 2))]
    cut = rng.integers(1, CHAIN, len(switched))
    tail = (np.arange(CHAIN)[None] >= cut[:, None]) & (word[switched] >= 0) & (word[other] >= 0)
    word[switched], truth[switched] = np.where(tail, word[other], word[switched]), np.where(tail, truth[other], truth[switched])
    real = word >= 0
    owner, bucket = words.ngrams(LENGTHS, BUCKETS)
    first = np.searchsorted(owner, np.arange(len(words.hashes)))
    wanted = np.eye(k)[truth] * real[:, :, None]
    share = 1 / real.sum()
    pairs_wanted = np.einsum("sti,stj->ij", wanted[:, :-1], wanted[:, 1:])
    adam = Adam(model, 0.05)
    for _ in range(steps):
        scores = np.add.reduceat(model["emission"][bucket], first, axis=0)
        unary = np.where(real[:, :, None], scores[word], 0)
        marginal, pairs, _ = forward_backward(unary, real, model["transition"], model["start"])
        delta = (marginal * real[:, :, None] - wanted) * share
        flat, at = delta[real], word[real]
        by_word = np.stack([np.bincount(at, flat[:, j], len(words.hashes)) for j in range(k)], 1)
        by_bucket = np.stack([np.bincount(bucket, by_word[owner, j], BUCKETS) for j in range(k)], 1)
        adam.step({"emission": by_bucket + 1e-8 * model["emission"], "transition": (pairs - pairs_wanted) * share, "start": delta[:, 0].sum(0)})
    return Model(known, model["emission"].astype(np.float32), model["transition"], model["start"])


def chain_marginals(unary: np.ndarray, row: np.ndarray, n_rows: int, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of every word, words x labels, where all words of a row, rows ascending, are one chain.

    A chain is cut into segments of CHAIN words, of all chains at once: the product of a segment's matrices says what it
    makes of any message, so messages go from segment to segment in a few steps, and from there to each word.
    """
    n, k = unary.shape
    if not n:
        return np.zeros((0, k))
    segment, place, s = chains(row, n_rows, CHAIN)
    emit, real = np.ones((CHAIN, s, k)), np.zeros((CHAIN, s), bool)
    emit[place, segment], real[place, segment] = np.exp(unary - unary.max(1, keepdims=True)), True
    move, begin = np.exp(transition), np.exp(start)
    per_row = -(-np.bincount(row, minlength=n_rows) // CHAIN)
    per_row = per_row[per_row > 0]
    first = np.cumsum(per_row) - per_row
    opens = np.zeros(s, bool)
    opens[first] = True
    # messages into and out of segments; the longest chains first, so that those still going on are a prefix
    order = np.argsort(-per_row, kind="stable")
    at, left = first[order], per_row[order]
    before, after = np.full((s, k), 1 / k), np.ones((s, k))
    if left[0] > 1:
        step = np.where(opens[:, None, None], begin[None, None], move[None]) * emit[0][:, None]
        for i in range(1, CHAIN):
            step = np.where(real[i][:, None, None], (step.reshape(-1, k) @ move).reshape(s, k, k) * emit[i][:, None], step)
            if i % 8 == 7:
                step /= step.max((1, 2), keepdims=True)
        for j in range(1, left[0]):
            on = at[: np.searchsorted(-left, -j, "left")]
            x = np.einsum("si,sij->sj", before[on + j - 1], step[on + j - 1])
            before[on + j] = x / x.sum(1, keepdims=True)
        for j in range(left[0] - 1, 0, -1):
            on = at[: np.searchsorted(-left, -j, "left")]
            x = np.einsum("sij,sj->si", step[on + j], after[on + j])
            after[on + j - 1] = x / x.sum(1, keepdims=True)
    ahead = np.empty((CHAIN, s, k))
    a = np.where(opens[:, None], begin, before @ move) * emit[0]
    ahead[0] = a / a.sum(1, keepdims=True)
    for i in range(1, CHAIN):
        a = (ahead[i - 1] @ move) * emit[i]
        ahead[i] = np.where(real[i][:, None], a / a.sum(1, keepdims=True), ahead[i - 1])
    back = after
    for i in range(CHAIN - 1, -1, -1):
        ahead[i] *= back  # now the marginals
        b = (emit[i] * back) @ move.T
        back = np.where(real[i][:, None], b / b.sum(1, keepdims=True), back)
    out = ahead[place, segment]
    return out / out.sum(1, keepdims=True)


def label_words(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Row and language marginals of every word with letters of a run of texts, in text order; a text is one chain."""
    words = words_of(data, offsets, letters_only=True)
    scores = word_scores(words, model.emission)
    return words.row, chain_marginals(scores[words.word], words.row, len(offsets) - 1, model.transition, model.start)


def predict_texts(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language of each text, that with the largest mean marginal over its words, and that mean.

    Of a run of texts only these two are kept, so what a batch takes doesn't grow with its words.
    """
    n, k = len(texts), len(model.languages)
    names, score = [UNKNOWN] * n, np.zeros(n)
    if not k:
        return names, score
    data, offsets = text_bytes(texts)
    for a, b in runs(offsets, CHUNK_BYTES // 2):
        own, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        row, marginal = label_words(own, bounds, model)
        counts = np.bincount(row, minlength=b - a)
        mean = np.stack([np.bincount(row, marginal[:, j], b - a) for j in range(k)], 1) / np.maximum(counts, 1)[:, None]
        best = mean.argmax(1)
        ascii_letter = np.r_[0, np.cumsum(((own | 32) >= 97) & ((own | 32) <= 122))]
        sure = ascii_letter[bounds[1:]] > ascii_letter[bounds[:-1]]
        for i in range(b - a):
            if sure[i] or any(c.isalpha() for c in own[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace")):
                names[a + i], score[a + i] = model.languages[best[i]], mean[i, best[i]]
    return names, np.clip(score, 0, 1)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = 3, held_out: int = 1) -> Model:
    """The model from up to per_language documents of each language outside the held-out fold, the first by a hash of the id.

    Somewhat more than that many are taken by a share of the hash range for each language, ids and languages that are
    repeated put together, and cut to the first in the task that learns.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() % folds != held_out))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(1.5 * per_language + 20) / F.col("n")).alias("share"))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    # a row for each language, as many as the model, which is broadcast too, has columns
    near = known.join(F.broadcast(share), "lang").where(rank < F.col("share") * F.lit(float(1 << 40)))
    sample = near.groupBy(rank.alias("rank"), "doc_id", "lang").agg(F.min("text").alias("text"))

    def learn(table: pa.Table) -> Model:
        texts, languages, taken = [], [], {}
        for _, _, lang, text in sorted(zip(*(table[c].to_pylist() for c in ("rank", "doc_id", "lang", "text")), strict=True)):
            taken[lang] = taken.get(lang, 0) + 1
            if taken[lang] <= per_language:
                texts.append(text)
                languages.append(lang)
        return train(pa.array(texts, pa.string()), languages)

    return fitted(sample, learn)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs, and lang_pred and score.

    One pass without a shuffle; the model, of fixed size, is broadcast. Texts that are null or have no letter get
    `und` and 0. Repeated rows each get their row, an empty table none. Columns of docs by the new names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def body(batch: pa.RecordBatch) -> list[pa.Array]:
        names, score = predict_texts(batch.column("text"), held.value)
        return [pa.array(names, pa.string()), pa.array(score)]

    return with_columns(docs, "lang_pred string, score double", body)


def query(docs: DataFrame) -> DataFrame:
    found = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs))
    return found.select("doc_id", F.coalesce(fold() % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
