"""Benchmark passages in training texts, found by spaced seeds and verified with tolerance for substituted words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Workspace, kept_rows, mix, prefix_hash, runs, span_hash, text_bytes, unused_name, with_columns

#: Which tokens of a window a seed looks at; the others may differ. Together they hit every overlap that counts: for each
#: length from MIN_TOKENS to WINDOW and each choice of the substitutions allowed, one of them at some place sees none.
MASKS = ("110111", "11010011", "11111")
#: Tokens of an overlap; of an item with fewer tokens, all. In a fifth of them, rounded down, item and text may differ.
WINDOW = 20
#: Items with fewer tokens than this are looked for as they are, without a substitution, by the hash of all their tokens.
MIN_TOKENS = 8
#: Hits of seeds that are verified at once.
HITS = 1 << 18
#: Bytes of benchmark texts that are broadcast at once; a larger benchmark goes over the documents in several blocks.
BLOCK_BYTES = 8 << 20

IN_TOKEN = np.zeros(256, bool)
IN_TOKEN[[c for c in range(128) if chr(c).isalnum()] + list(range(128, 256))] = True


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token: runs of ASCII letters, digits and bytes over 127, in lower case."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = IN_TOKEN[data]
    first, last = inside.copy(), inside.copy()
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hash(prefix_hash(LOWER[data]), starts, ends), np.searchsorted(offsets, starts, "right") - 1


def seeds(tokens: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the mask's seed at each token whose window stays in its row."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, 0x9E3779B97F4A7C15 ^ int(mask, 2), np.uint64)
    for i, on in enumerate(mask):
        if on == "1":
            h = h * np.uint64(0xBF58476D1CE4E5B9) + tokens[i : i + n]
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    return at, mix(h[at])


@dataclass
class Benchmark:
    """The items' tokens in a row, and the sorted seeds of each mask with their places. A short item has one seed, all of it."""

    items: np.ndarray
    tokens: np.ndarray
    start: np.ndarray  # of each item, and the end
    masks: list[str]
    hashes: list[np.ndarray]
    places: list[np.ndarray]
    maybe: np.ndarray  # whether a seed hash ends in these bits

    @classmethod
    def of(cls, items: list[int], texts: list[str]) -> Benchmark:
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        tokens, row = tokens_of(data, offsets)
        counts = np.bincount(row, minlength=len(items))
        keep = counts > 0
        tokens, row = tokens, (np.cumsum(keep) - 1)[row] if len(row) else row
        counts = counts[keep]
        start = np.r_[0, np.cumsum(counts)].astype(np.int64)
        long = counts >= MIN_TOKENS
        masks = [*MASKS, *("1" * int(n) for n in np.unique(counts[~long]))]
        hashes, places = [], []
        for i, mask in enumerate(masks):
            at, h = seeds(tokens, row, mask)
            wanted = long[row[at]] if i < len(MASKS) else counts[row[at]] == len(mask)
            at, h = at[wanted], h[wanted]
            order = np.argsort(h, kind="stable")
            hashes.append(h[order])
            places.append(at[order])
        bits = max(16, int(np.ceil(np.log2(max(1, sum(map(len, hashes))) * 16))))
        maybe = np.zeros(1 << bits, bool)
        for h in hashes:
            maybe[(h & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        return cls(np.array(items, np.int64)[keep], tokens, start, masks, hashes, places, maybe)

    def overlaps(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """Tokens of each row, and every verified overlap as (row, item, first token, end token), tokens of the row.

        Hits of seeds are put together by row, item and diagonal, so many at once; on each of those the item's tokens are
        laid beside the text's, and windows with enough equal ones count. Overlaps of one diagonal are unions of windows.
        """
        tokens, row = tokens_of(data, offsets)
        counts = np.bincount(row, minlength=len(offsets) - 1)
        begin = np.cumsum(counts) - counts
        low = np.uint64(len(self.maybe) - 1)
        out: set[tuple[int, int, int, int]] = set()
        for mask, hashes, places in zip(self.masks, self.hashes, self.places, strict=True):
            at, h = seeds(tokens, row, mask)
            near = self.maybe[(h & low).astype(np.int64)]
            at, h = at[near], h[near]
            a, b = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            ends = np.cumsum(b - a)
            for x in range(0, int(ends[-1]) if len(ends) else 0, HITS):
                # hits number x to x + HITS, of which a seed that many items share has many
                number = np.arange(x, min(x + HITS, int(ends[-1])))
                own = np.searchsorted(ends, number, "right")
                place = places[b[own] - (ends[own] - number)]
                item = np.searchsorted(self.start, place, "right") - 1
                hits = np.unique(np.stack([row[at[own]], item, at[own] - place], 1), axis=0)
                for r, i, shift in hits.tolist():
                    out.update(self._verified(tokens, r, i, shift, int(begin[r]), int(counts[r])))
        return counts, sorted(out)

    def _verified(self, tokens: np.ndarray, r: int, item: int, shift: int, begin: int, count: int):
        s, e = int(self.start[item]), int(self.start[item + 1])
        width = min(WINDOW, e - s)
        a, b = max(s + shift, begin), min(e + shift, begin + count)
        if b - a < width:
            return
        same = np.r_[0, np.cumsum(tokens[a:b] == self.tokens[a - shift : b - shift])]
        allowed = width // 5 if e - s >= MIN_TOKENS else 0
        good = np.flatnonzero(same[width:] - same[:-width] >= width - allowed)
        if len(good):
            firsts = good[np.r_[True, good[1:] > good[:-1] + width]]
            lasts = good[np.r_[good[1:] > good[:-1] + width, True]] + width
            yield from ((r, int(self.items[item]), a - begin + int(x), a - begin + int(y)) for x, y in zip(firsts, lasts, strict=True))


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES, empty: bool = False):
    """The benchmark in blocks of bounded size, in order of item; none if it has no items, or with `empty` one without any."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    items, texts, size = [], [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if items and size + len(r[1]) > limit:
            yield Benchmark.of(items, texts)
            items, texts, size = [], [], 0
        items.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    if items or empty:
        yield Benchmark.of(items, texts)


def _per_row(held, texts) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """Tokens and verified overlaps (item, first, end) of each text, a run of texts at a time."""
    data, offsets = text_bytes(texts)
    n_tokens, found = [np.zeros(0, np.int64)], []
    for a, b in runs(offsets):
        counts, overlaps = held.value.overlaps(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n_tokens.append(counts)
        mine: list[list[tuple[int, int, int]]] = [[] for _ in range(b - a)]
        for r, *span in overlaps:
            mine[r].append(tuple(span))
        found += mine
    return np.concatenate(n_tokens), found


def _covered(spans: list[tuple[int, int, int]]) -> int:
    n, until = 0, 0
    for first, last in sorted((f, e) for _, f, e in spans):
        n += max(0, last - max(first, until))
        until = max(until, last)
    return n


SPANS = "array<struct<item:bigint,first:bigint,last:bigint>>"


def find(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs, and n_tokens, n_matched (tokens in verified overlaps), items (sorted ids), contaminated, spans.

    An overlap is a window of WINDOW tokens of an item, all of it if it has fewer, that stands in the text without gaps
    and with at most a fifth of the tokens, rounded down, replaced. The seeds find every such overlap. Of an item of
    fewer than MIN_TOKENS tokens it is all of them as they are. spans has the item, first and end token of each.

    One pass over docs for each block of the benchmark of `limit` bytes, mostly one; a block is broadcast, and what it
    finds is written to the shared folder before the next. No shuffle. Null and empty texts, and null and empty items,
    match nothing. A repeated item counts once; repeated rows of docs each get their row; an empty table gives none.
    Columns of docs by the new names are replaced.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    before = unused_name(docs.columns, "before")
    kept = docs.drop("n_tokens", "n_matched", "items", "contaminated", "spans")
    out, more = kept.withColumn(before, F.array().cast(SPANS)), False
    for block in blocks(benchmark, limit, empty=True):
        held = spark.sparkContext.broadcast(block)
        if more:
            out = work.save(out.select(*[F.col(f"`{c}`") for c in kept.columns], F.col("spans").alias(before)), "blocks")

        def body(batch: pa.RecordBatch, held=held) -> list[pa.Array]:
            counts, found = _per_row(held, batch.column("text"))
            found = [sorted({*((s["item"], s["first"], s["last"]) for s in old), *new}) for old, new in zip(batch.column(before).to_pylist(), found, strict=True)]
            items = [sorted({s[0] for s in f}) for f in found]
            spans = pa.array([[{"item": i, "first": a, "last": b} for i, a, b in f] for f in found], pa.list_(pa.struct([("item", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])))
            return [pa.array(counts.astype(np.int64)), pa.array([_covered(f) for f in found], pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array([bool(f) for f in items], pa.bool_()), spans]

        out, more = with_columns(out, f"n_tokens long, n_matched long, items array<bigint>, contaminated boolean, spans {SPANS}", body), True
    return out.drop(before)


def decontaminate(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark, with the columns of docs, whatever their names; see find."""
    spark, work, out = docs.sparkSession, Workspace(docs.sparkSession), docs
    for i, block in enumerate(blocks(benchmark, limit)):
        held = spark.sparkContext.broadcast(block)
        if i:
            out = work.save(out, "blocks")
        out = kept_rows(out, lambda batch, held=held: np.array([not f for f in _per_row(held, batch.column("text"))[1]], bool))
    return out


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, kept (no passage in it), n_tokens, n_matched, and the matched items' ids parted by commas."""
    found = find(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    return found.select("doc_id", (~F.col("contaminated")).alias("kept"), "contaminated", "n_tokens", "n_matched", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"))


#: op10_decontaminate by laying items beside texts wherever they share tokens enough.
SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), items AS (
  SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)
), widths AS (
  SELECT item_id, i, len(w) AS n, least(20, len(w)) AS width, CASE WHEN len(w) < 8 THEN len(w) ELSE least(20, len(w)) - least(20, len(w)) // 5 END AS need FROM items
), x AS (
  SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM docs
), y AS (
  SELECT i, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM items
), diagonals AS (
  SELECT x.r, y.i, x.p - y.p AS shift, list(y.p) AS same FROM x JOIN y ON x.t = y.t GROUP BY ALL HAVING count(*) >= 4 OR count(*) >= (SELECT min(need) FROM widths)
), windows AS (
  SELECT g.r, v.item_id, v.width, v.need, g.shift, g.same, unnest(range(greatest(1, 1 - g.shift), least(v.n, len(d.w) - g.shift) - v.width + 2)) AS q
  FROM diagonals g JOIN widths v ON v.i = g.i JOIN docs d ON d.r = g.r WHERE len(g.same) >= v.need
), found AS (
  SELECT r, item_id, q + shift AS a, width FROM windows WHERE len(list_filter(same, lambda p: p >= q AND p < q + width)) >= need
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(a, a + width)) AS p FROM found) GROUP BY r
), hit AS (
  SELECT r, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS items FROM found GROUP BY r
)
SELECT d.doc_id, h.r IS NULL AS kept, h.r IS NOT NULL AS contaminated, CAST(len(d.w) AS BIGINT) AS n_tokens, coalesce(c.n, 0) AS n_matched, coalesce(h.items, '') AS items
FROM docs d LEFT JOIN hit h ON h.r = d.r LEFT JOIN covered c ON c.r = d.r"""
