"""Conflict-constrained best-fit packing of documents into training sequences of a fixed length."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_arrow, mix, powers, prefix_hash, runs, span_hash, text_bytes, word_spans

CAPACITY = 2048
BLOCK = 4096
#: Blocks a task packs, so that tasks grow with the rows and a task's work does not.
BLOCKS_PER_TASK = 4

PACKED = "doc_id long, piece long, first_word long, n_words long, bin_id string, bin_offset long"


def best_fit(lengths, sources, clusters, capacity: int) -> tuple[list[int], list[int]]:
    """Bin number and offset of every item, longest first, each into the fullest bin that can take it.

    A bin can take an item if it has room and holds none of the item's source and none of its duplicate cluster.
    Open bins stand in order of what room they have left; from the first that is roomy enough the search goes on to
    the next roomier one until a bin is compatible. Items must come longest first. A source or cluster under 0
    conflicts with nothing. Bins carry their sources and clusters as bitmaps; a cluster that occurs once has no bit.
    """
    bit: dict[tuple, int] = {}
    for kind, values in (("s", sources), ("c", clusters)):
        seen, twice = set(), set()
        for v in values:
            if v >= 0:
                (twice if v in seen else seen).add(v)
        for v in sorted(twice):
            bit[kind, v] = 1 << len(bit)
    rooms: list[tuple[int, int]] = []
    held: list[int] = []
    bins, offsets = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        own = bit.get(("s", s), 0) | bit.get(("c", c), 0)
        at = bisect_left(rooms, (n, -1))
        while at < len(rooms) and held[rooms[at][1]] & own:
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(held)
            held.append(0)
        held[b] |= own
        bins.append(b)
        offsets.append(capacity - room)
        if room > n:
            insort(rooms, (room - n, b))
    return bins, offsets


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words of each text, and the hash of its lower-cased words as the duplicate cluster."""

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        n_words, cluster = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
        for a, b in runs(offsets):
            part = LOWER[data[offsets[a] : offsets[b]]]
            starts, ends, rows = word_spans(part, offsets[a : b + 1] - offsets[a])
            n_words[a:b] = np.bincount(rows, minlength=b - a)
            if len(rows):
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
                words = span_hash(prefix_hash(part), starts, ends)
                cluster[a + rows[first]] = np.add.reduceat(words * powers(0xD6E8FEB86659FD93, int(place.max()) + 1)[place], first)
        cluster = mix(cluster + n_words.astype(np.uint64)).view(np.int64)
        return pa.record_batch({"doc_id": batch.column(0), "source": batch.column(2), "n_words": n_words, "cluster": cluster})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    return map_arrow(own, body, "doc_id long, source string, n_words long, cluster long")


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack whole documents into bins of `capacity` words: one row per piece, with its bin and its place there.

    Only lengths, sources and cluster hashes are shuffled, never texts: rows are dealt round-robin into blocks of
    `block` documents, and each block is packed alone by best_fit, so a hot source or cluster spreads evenly over
    all blocks. In a bin no two pieces share a source or a duplicate cluster (equal lower-cased words).
    A text longer than a bin is cut into full bins and a rest, which is packed as any other.

    Null or empty texts give one row of 0 words whose bin_id is null. A null source, and a null doc_id, conflict with
    nothing by that column. Repeated rows are packed each, never into one bin. An empty table gives no rows. Other
    columns are ignored.
    """
    per_task = block * BLOCKS_PER_TASK
    tasks = max(1, -(-docs.count() // per_task))

    def body(batches):
        from pyspark import TaskContext

        task, n, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held.append(batch)
            while sum(x.num_rows for x in held) >= block:
                table = pa.Table.from_batches(held)
                yield _pack_block(table.slice(0, block), capacity, f"{task}-{n}")
                held, n = table.slice(block).to_batches(), n + 1
        if sum(x.num_rows for x in held):
            yield _pack_block(pa.Table.from_batches(held), capacity, f"{task}-{n}")

    return measured(docs, id_col, text_col, source_col).repartition(tasks).mapInArrow(body, PACKED)


def _pack_block(table: pa.Table, capacity: int, name: str) -> pa.RecordBatch:
    ids = table["doc_id"].to_pylist()
    words = table["n_words"].to_numpy()
    sources = table["source"].combine_chunks().dictionary_encode()
    sources = sources.combine_chunks() if isinstance(sources, pa.ChunkedArray) else sources
    source = [-1 if x is None else x for x in sources.indices.to_pylist()]
    _, cluster = np.unique(table["cluster"].to_numpy(), return_inverse=True)
    items = []  # (-length, row, piece, first word)
    empty = []
    for row, n in enumerate(words.tolist()):
        if not n:
            empty.append(row)
        for piece, at in enumerate(range(0, n, capacity)):
            items.append((-min(capacity, n - at), row, piece, at))
    items.sort(key=lambda x: (x[0], ids[x[1]] is None, ids[x[1]] or 0, x[2], x[1]))
    bins, offsets = best_fit([-x[0] for x in items], [source[x[1]] for x in items], [int(cluster[x[1]]) for x in items], capacity)
    columns = {
        "doc_id": pa.array([ids[x[1]] for x in items] + [ids[r] for r in empty], pa.int64()),
        "piece": pa.array([x[2] for x in items] + [0] * len(empty), pa.int64()),
        "first_word": pa.array([x[3] for x in items] + [0] * len(empty), pa.int64()),
        "n_words": pa.array([-x[0] for x in items] + [0] * len(empty), pa.int64()),
        "bin_id": pa.array([f"{name}-{b}" for b in bins] + [None] * len(empty), pa.string()),
        "bin_offset": pa.array([*offsets, *[None] * len(empty)], pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)
