"""Counts of the tokens that a unigram tokenizer cuts texts into, without cutting: one trie of words per worker."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, runs, text_bytes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Nodes that a worker's trie may have; beyond, it starts anew. Results don't depend on it.
TRIE_NODES = 600_000
SPACE = "▁"


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and log-probabilities of a sentencepiece model, without its control and byte pieces.

    The scores of a unigram model are its log-probabilities. Those of a model of another kind only rank its pieces, the
    likelier first; their probabilities are taken to fall with the rank as Zipf's law has it, in proportion to 1 / rank.
    No piece is added or learned.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    if abs(sum(map(math.exp, scores.values())) - 1) < 0.1:
        return scores
    ranked = sorted(scores, key=lambda p: (-scores[p], p))
    total = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(ranked, 1)}


class ForwardTrie:
    """Token counts of words under the best segmentation by a unigram model.

    Distinct words are put into one trie, which lasts from call to call. A node holds the forward score of its prefix,
    that is the best sum of the scores of pieces that make it up, and the number of those pieces. It needs only its
    ancestors' scores and is worked out once, when the node is made, for all words that share the prefix. The node at
    which a word ends has its count of tokens, and keeps it as a terminal.

    Of segmentations with equal scores the one with fewer pieces counts. A character that is no piece is cut into its
    UTF-8 bytes, each a token, at a score 10 below the lowest for each.
    """

    def __init__(self, vocabulary: dict[str, float], limit: int = TRIE_NODES):
        self.limit = limit
        self.low = min(vocabulary.values(), default=0.0) - 10
        self.ends: dict = {}  # trie of the pieces read backwards; None: the score of the piece that ends here
        for piece, score in vocabulary.items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[None] = score
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # by the node and, in the lowest 21 bits, the character
        self.score, self.pieces = [0.0], [0]
        self.terminal: dict[bytes, int] = {}  # words and the nodes at which they end

    def insert(self, word: bytes) -> int:
        """The node at which the word ends; those of its prefix that are new are scored."""
        text = SPACE + word.decode("utf-8", "replace")
        path = [0]
        for c in text:
            at = path[-1]
            step = at << 21 | ord(c)
            node = self.children.get(step)
            if node is None:
                node = self.children[step] = len(self.score)
                best, count = self._forward(text, path)
                self.score.append(best)
                self.pieces.append(count)
            path.append(node)
        self.terminal[word] = path[-1]
        return path[-1]

    def _forward(self, text: str, path: list[int]) -> tuple[float, int]:
        """Best score and number of pieces of the prefix that is one character longer than path."""
        end = at = len(path)
        best, count, node = None, 0, self.ends
        while at:
            at -= 1
            node = node.get(text[at])
            if node is None:
                break
            if None in node:
                s, p = self.score[path[at]] + node[None], self.pieces[path[at]] + 1
                if best is None or s > best or s == best and p < count:
                    best, count = s, p
        if None not in self.ends.get(text[end - 1], ()):
            n = len(text[end - 1].encode("utf-8", "replace"))
            s = self.score[path[-1]] + n * self.low
            if best is None or s > best:
                best, count = s, self.pieces[path[-1]] + n
        return best, count

    def of(self, texts: list[list[bytes]]) -> list[int]:
        """Tokens of each list of words."""
        if len(self.score) > self.limit:
            self.clear()
        for word in set().union(*texts) - self.terminal.keys():
            self.insert(word)
        node, pieces = self.terminal, self.pieces
        return [sum(pieces[node[w]] for w in words) for words in texts]


_tries: dict[bytes, ForwardTrie] = {}


def trie_of(vocabulary: dict[str, float], digest: bytes) -> ForwardTrie:
    """The trie that this worker keeps for the vocabulary of this digest; it keeps one."""
    if digest not in _tries:
        _tries.clear()
        _tries[digest] = ForwardTrie(vocabulary)
    return _tries[digest]


def count_tokens(docs: DataFrame, vocabulary: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words and n_tokens of its whole text.

    Words are what is between spaces, tabs and line breaks; each is cut with a leading space mark, as the model's
    pieces expect, and white space itself counts nothing. One pass without a shuffle, a run of texts of bounded size at a
    time; the vocabulary, of fixed size, is the only thing broadcast. Null and empty texts have 0 words and 0 tokens.
    With an empty vocabulary every byte is a token. Null ids and repeated rows stay, a row each; an empty table gives no
    rows; other columns are ignored.
    """
    digest = hashlib.sha256(repr(sorted(vocabulary.items())).encode()).digest()
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        trie = trie_of(held.value, digest)
        data, offsets = text_bytes(batch.column(1))
        n_words, n_tokens = [], []
        for a, b in runs(offsets):
            raw, at = data[offsets[a] : offsets[b]].tobytes(), offsets[a : b + 1] - offsets[a]
            texts = [raw[at[i] : at[i + 1]].split() for i in range(b - a)]
            n_words += map(len, texts)
            n_tokens += trie.of(texts)
        return pa.record_batch({"doc_id": batch.column(0), "n_words": np.array(n_words, np.int64), "n_tokens": np.array(n_tokens, np.int64)})

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), body, "doc_id long, n_words long, n_tokens long")


def query(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return count_tokens(docs, load_vocabulary(path))
