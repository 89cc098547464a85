"""Words of a run of texts, each distinct word once, and the hashed character n-grams of those."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import LOWER, mix, prefix_hash, span_hash, word_spans

OPEN, CLOSE = ord("<"), ord(">")


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII, and of the accented capitals that UTF-8 writes as 0xC3 and one byte more."""
    out = LOWER[data]
    if len(out) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accented] += 0x20
    return out


@dataclass
class Words:
    """The words of some rows: `row` and `word` (a number into the distinct words) of each, in text order."""

    row: np.ndarray
    word: np.ndarray
    #: Bytes of the distinct words, each as <word>, and where they start; n + 1 numbers.
    data: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def ngrams(self, lengths, buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word and bucket of every n-gram of <word>, words ascending; whole: and one of the word itself."""
        prefix = prefix_hash(self.data)
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        end = self.bounds[1:][owner] if len(owner) else owner
        at = np.arange(len(self.data))
        ids, words = [], []
        for n in lengths:
            ok = at + n <= end
            starts = at[ok]
            ids.append(span_hash(prefix, starts, starts + n))
            words.append(owner[ok])
        if whole:
            ids.append(mix(self.hashes + np.uint64(0x51ED27)))
            words.append(np.arange(len(self.hashes)))
        word = np.concatenate(words) if words else np.zeros(0, np.int64)
        bucket = (np.concatenate(ids) % np.uint64(buckets)).astype(np.int64) if ids else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return word[order], bucket[order]


def words_of(data: np.ndarray, offsets: np.ndarray, letters_only: bool = False) -> Words:
    """The lower-cased words of each row; letters_only: those with an ASCII letter or a byte over 127."""
    data = lowered(data)
    starts, ends, rows = word_spans(data, offsets)
    if letters_only and len(starts):
        letter = ((data >= 97) & (data <= 122)) | (data > 127)
        counts = np.r_[0, np.cumsum(letter)]
        keep = counts[ends] > counts[starts]
        starts, ends, rows = starts[keep], ends[keep], rows[keep]
    hashes = span_hash(prefix_hash(data), starts, ends)
    hashes, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    bounds = np.r_[0, np.cumsum(ends - starts + 2)].astype(np.int64)
    out = np.empty(int(bounds[-1]), np.uint8)
    out[bounds[:-1]] = OPEN
    out[bounds[1:] - 1] = CLOSE
    inner = np.ones(len(out), bool)
    inner[bounds[:-1]] = False
    inner[bounds[1:] - 1] = False
    lengths = ends - starts
    out[inner] = data[np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(int(lengths.sum()))] if len(lengths) else 0
    return Words(rows, word, out, bounds, hashes)


def means(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Mean of the values of each group 0..n-1; 0 where there are none."""
    return np.bincount(groups, values, n) / np.maximum(np.bincount(groups, minlength=n), 1)
