"""Near-duplicates by min-max hashing: candidates from banded signatures, links confirmed on full shingle sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, Workspace, map_arrow, mix, prefix_hash, runs, span_hash, text_bytes, word_spans
from .components import components

PERMUTATIONS = 120
#: Shingles of a block, about, in which members of a bucket that are apart yet are compared.
BLOCK = 200_000
_rng = np.random.default_rng(1017)
_A = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


@dataclass(frozen=True)
class Similarity:
    """Words of a shingle, and the Jaccard similarity from which documents are linked, in percent."""

    shingle: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        """Values of a band. A pair at the threshold shares none of the bands with a probability under 1e-8."""
        n, t = 2 * PERMUTATIONS, self.percent / 100
        return max([1, *(r for r in range(1, 33) if (1 - t**r) ** (n // r) < 1e-8)])

    @property
    def agreement(self) -> float:
        """Share of equal signature bytes under which a pair is none: seven deviations below the threshold."""
        t = self.percent / 100
        return t - 7 * (t * (1 - t) / (2 * PERMUTATIONS)) ** 0.5


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one row after the other, and their n + 1 bounds.

    A shingle is k words in lower case (A-Z); a row with fewer words has one, of all its words; without words none.
    """
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, row = word_spans(low, offsets)
    words = span_hash(prefix_hash(low), starts, ends)
    counts = np.bincount(row, minlength=n)
    begin = np.cumsum(counts) - counts
    short = (counts > 0) & (counts < k)
    sizes = np.where(short, 1, np.maximum(counts - k + 1, 0))
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    h = np.full(len(at), k, np.uint64)
    wide = np.repeat(np.where(short, counts, k), sizes)
    for i in range(k):
        on = wide > i
        h = np.where(on, h * np.uint64(0x9FB21C651E98DF25) + words[np.minimum(at + i, max(len(words) - 1, 0))] if len(words) else h, h)
    h = mix(h + wide.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    bounds = np.r_[0, np.cumsum(sizes)]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    if not len(h):
        return h, bounds
    owner = np.repeat(np.arange(n), sizes)
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
    return h[new], np.r_[0, np.cumsum(np.bincount(owner[new], minlength=n))]


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of every set that isn't empty, the least value under each permutation, then the largest under each."""
    first = bounds[:-1][bounds[1:] > bounds[:-1]]
    x = (mix(h ^ np.uint64(0x5DEECE66D)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), 2 * PERMUTATIONS), np.uint32)
    if not len(first):
        return out
    for p in range(PERMUTATIONS):
        v = x * _A[p] + _B[p]
        out[:, p] = np.minimum.reduceat(v, first)
        out[:, PERMUTATIONS + p] = np.maximum.reduceat(v, first)
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Hash of each band of a signature; no band has a permutation twice unless it is longer than the signature's half."""
    n = signature.shape[1] // rows
    out = np.empty((len(signature), n), np.uint64)
    for j in range(n):
        h = np.full(len(signature), j + 1, np.uint64)
        for i in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, j * rows + i])
        out[:, j] = h
    return out


def _signed(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, size of the set, its fingerprint, sketch (a byte of each signature value) and band hashes."""
    rows = sim.rows
    n_bands = 2 * PERMUTATIONS // rows

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        n = batch.num_rows
        size, prints = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
        sketch, keys = [], []
        for a, b in runs(offsets, CHUNK_BYTES // 4):
            h, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], sim.shingle)
            size[a:b] = np.diff(bounds)
            full = np.flatnonzero(size[a:b])
            if len(full):
                first = bounds[:-1][full]
                prints[a + full, 0] = np.add.reduceat(mix(h + np.uint64(11)), first)
                prints[a + full, 1] = np.add.reduceat(mix(h ^ np.uint64(0xABCDEF12345)), first)
            signature = signatures(h, bounds)
            sketch.append((signature ^ (signature >> np.uint32(16))).astype(np.uint8))
            keys.append(bands(signature, rows))
        sketch = np.concatenate(sketch) if sketch else np.zeros((0, 2 * PERMUTATIONS), np.uint8)
        keys = np.concatenate(keys) if keys else np.zeros((0, n_bands), np.uint64)
        full = size > 0
        ends = np.cumsum(full)
        sketches = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.r_[0, ends] * 2 * PERMUTATIONS).astype(np.int32)), pa.py_buffer(sketch.tobytes())])
        lists = pa.ListArray.from_arrays(pa.array((np.r_[0, ends] * n_bands).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)), sketches, lists], ["doc_id", "n_shingles", "f1", "f2", "sketch", "bands"])

    return map_arrow(docs, body, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary, bands array<long>")


def _alike(pairs: DataFrame, sim: Similarity) -> DataFrame:
    """a and b of the pairs(a, b, sa, sb) whose sketches agree enough for them to be links."""
    least = sim.agreement * 2 * PERMUTATIONS

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(text_bytes(batch.column(i))[0], np.uint8).reshape(-1, 2 * PERMUTATIONS) for i in (2, 3))
        return batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= least))

    return map_arrow(pairs, body, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """a and b of the pairs(a, b) whose full shingle sets are similar enough; texts: doc_id and text of both."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = np.zeros(batch.num_rows, bool)
        sides = [text_bytes(batch.column(i)) for i in (2, 3)]
        total = sides[0][1] + sides[1][1]
        for a, b in runs(total, CHUNK_BYTES // 4):
            (x, xb), (y, yb) = (shingle_sets(data[o[a] : o[b]], o[a : b + 1] - o[a], sim.shingle) for data, o in sides)
            for i in range(b - a):
                p, q = x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]]
                shared = np.count_nonzero(np.diff(np.sort(np.concatenate([p, q]), kind="stable").view(np.int64)) == 0)
                good[a + i] = 100 * shared >= sim.percent * (len(p) + len(q) - shared)
        return batch.select([0, 1]).filter(pa.array(good))

    return map_arrow(both, body, "a long, b long")


def near_duplicates(docs: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept; see shingle_sets for the sets.

    Documents are linked if their sets are similar enough; component_id is the smallest doc_id that links lead to, the
    document's own included, and kept says whether that is its own.

    Equal sets are put together first, and one of each goes on. Of the values of each signature, bands make buckets.
    In a bucket every member is compared with the smallest, which joins most of what belongs together; then, where a
    bucket still holds several components, members of different ones, on full sets, in blocks of which only links are
    given out. A pair with the smallest is compared by its sketches first, and confirmed on its texts.
    Nothing is capped; buckets that hold one component are done. All tables on the way are written to the shared folder.

    Null and empty texts, and those without words, have 0 shingles and are linked with nothing. Rows with the same
    doc_id are one document, linked by what any of them is like; rows with a null doc_id are linked with nothing, have
    a null component_id and are kept. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = work.save(_signed(own, sim), "signed")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("sketch", "bands"), "doc_id").alias("s"))
    classes = work.save(classes.select("f1", "f2", "n_shingles", "rep", "s.sketch", "s.bands"), "classes")
    sketches = classes.select("rep", "sketch")
    # buckets of more than one
    spread = classes.select("rep", "n_shingles", F.explode("bands").alias("k"))
    hubs = spread.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub"))
    star = work.save(spread.join(hubs.where("n > 1").select("k", "n", "hub"), "k").select("k", "n", "hub", "rep", "n_shingles"), "star")
    needed = star.select(F.col("rep").alias("doc_id")).distinct()
    texts = work.save(own.join(needed, "doc_id", "left_semi"), "texts")
    sizes = star.select("rep", "n_shingles").distinct()

    def fits(pairs: DataFrame) -> DataFrame:
        """Pairs(a, b) whose sizes and sketches allow a link."""
        x = pairs.join(sizes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb")), "b")
        x = x.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * sim.percent).select("a", "b")
        x = x.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
        return _alike(x.select("a", "b", "sa", "sb"), sim)

    def labelled(frame: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
        found = labels.select(F.col("id").alias(column), F.col("component").alias("c"))
        return frame.join(found, column, "left").withColumn(name, F.coalesce("c", column)).drop("c")

    # rows of one doc_id in several classes
    member = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "f1", "f2", "n_shingles").join(classes.select("f1", "f2", "n_shingles", "rep"), ["f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", "f1", "f2", "rep")
    member = work.save(member, "member")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("doc_id")
    edges = member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    edges = work.save(edges, "edges")

    # every member and the smallest of each of its buckets
    pairs = star.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = work.save(_confirmed(work.save(fits(pairs), "pairs"), texts, sim), "links")
    edges = edges.union(links)
    labels = work.save(components(edges, work, "rounds"), "labels")
    # what is apart yet among the other members of a bucket
    rest = labelled(star.where("n > 2 AND rep <> hub").select("k", "rep", "n_shingles"), labels, "rep", "label")
    apart = rest.groupBy("k").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("k")
    rest = work.save(rest.join(apart, "k", "left_semi"), "rest")
    links = work.save(_in_blocks(rest, texts, sim), "links")
    if not links.isEmpty():
        labels = work.save(components(edges.union(links), work, "rounds"), "labels")

    out = labelled(member.select("doc_id", "n_shingles", "rep"), labels, "rep", "component_id").select("doc_id", "n_shingles", "component_id")
    bare = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = work.save(out.union(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result")
    work.drop(*(name for name in list(work.paths) if name != "result"))
    return out


def _in_blocks(rest: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """Links(a, b) between members(k, rep, n_shingles, label) of a bucket that are of different labels.

    Buckets of copies of one text mostly hold the same members, and have the same most frequent label; buckets with that
    in common are taken as one family, so that its members are compared once. Those of that label need no comparison
    with each other. They and the others are dealt into blocks of about BLOCK shingles; each block of the others meets
    each of the first, and of its own kind, in one row, where the full sets are compared by an index of their shingles.
    Only links are given out, for each member one to every other label.
    """
    counts = rest.groupBy("k", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("k").agg(F.max_by("label", F.struct("c", "label")).alias("family"))
    own = rest.join(main, "k").select("family", "rep", "n_shingles", "label").distinct().withColumn("first", F.col("label") == F.col("family"))
    size = own.groupBy("family").agg(*[F.greatest(F.ceil(F.coalesce(F.sum(F.when(F.col("first") == side, F.col("n_shingles"))), F.lit(0)) / BLOCK), F.lit(1)).cast("int").alias(name) for side, name in ((F.lit(True), "nf"), (F.lit(False), "no"))])
    own = own.join(size, "family").withColumn("block", F.pmod(F.hash("rep"), F.when(F.col("first"), F.col("nf")).otherwise(F.col("no"))))
    own = own.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").withColumn("m", F.struct("rep", "label", "text"))
    # cells: a block of others, the kind of the second side, and its block
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    firsts = own.where("first").select("family", "m", F.explode(upto(F.col("no"))).alias("i"), F.lit(True).alias("kind"), F.col("block").alias("j"), F.lit(1).alias("side"))
    others = own.where("NOT first").select("family", "m", F.col("block").alias("i"), F.lit(True).alias("kind"), F.explode(upto(F.col("nf"))).alias("j"), F.lit(0).alias("side"))
    among = own.where("NOT first").select("family", "m", "block", F.explode(upto(F.col("no"))).alias("o"))
    among = among.select("family", "m", F.least("block", "o").alias("i"), F.lit(False).alias("kind"), F.greatest("block", "o").alias("j"), F.when(F.col("block") <= F.col("o"), 0).otherwise(1).alias("side"))
    cells = firsts.unionByName(others).unionByName(among).groupBy("family", "i", "kind", "j").agg(F.collect_list(F.struct("side", "m")).alias("members"))

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [], []
        lists, alone = batch.column(1), batch.column(0).to_pylist()
        flat, cuts = lists.flatten(), lists.offsets.to_numpy()
        cuts = cuts - cuts[0]
        m = flat.field("m")
        side, rep, label = (x.to_numpy(zero_copy_only=False) for x in (flat.field("side"), m.field("rep"), m.field("label")))
        data, offsets = text_bytes(m.field("text"))
        for c, one in enumerate(alone):
            x, y = int(cuts[c]), int(cuts[c + 1])
            h, bounds = shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], sim.shingle)
            sizes = np.diff(bounds)
            at = np.arange(y - x)
            p, q = (at, at) if one else (at[side[x:y] == 0], at[side[x:y] == 1])
            # an index of the second side: its shingles in order, and whose they are
            held = np.concatenate([h[bounds[i] : bounds[i + 1]] for i in q]) if len(q) else h[:0]
            whose = np.repeat(np.arange(len(q)), sizes[q])
            order = np.argsort(held, kind="stable")
            held, whose = held[order], whose[order]
            for i in p:
                own_set = h[bounds[i] : bounds[i + 1]]
                low, high = np.searchsorted(held, own_set, "left"), np.searchsorted(held, own_set, "right")
                n = high - low
                spots = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                shared = np.bincount(whose[spots], minlength=len(q))
                good = (100 * shared >= sim.percent * (sizes[q] + sizes[i] - shared)) & (label[x + q] != label[x + i])
                if good.any():
                    _, once = np.unique(label[x + q[good]], return_index=True)
                    b += rep[x + q[good][once]].tolist()
                    a += [int(rep[x + i])] * len(once)
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return map_arrow(cells.select((~F.col("kind") & (F.col("i") == F.col("j"))).alias("alone"), "members"), body, "a long, b long")


#: op1_minhash_dedup by comparing all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM docs
), shingles AS (
  SELECT r, unnest(s) AS h FROM sets WHERE doc_id IS NOT NULL
), shared AS (
  SELECT x.r AS a, y.r AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.h = y.h AND x.r < y.r GROUP BY ALL
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shared JOIN sets x ON x.r = a JOIN sets y ON y.r = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), either AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS c FROM sets WHERE doc_id IS NOT NULL
  UNION
  SELECT reach.doc_id, either.b FROM reach JOIN either ON reach.c = either.a
), least AS (
  SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, coalesce(l.component_id = s.doc_id, true) AS kept
FROM sets s LEFT JOIN least l ON l.doc_id = s.doc_id"""
