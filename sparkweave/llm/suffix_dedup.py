"""Repeated byte strings across a corpus, by suffix arrays over shards in which all places of a string meet."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_arrow, mix, prefix_hash, runs, span_hash, text_bytes, unused_name
from .suffix_array import repeated_starts

#: Bytes of a string that counts as repeated.
WIDTH = 200
#: Bytes of the grams of which the least in a string of WIDTH bytes says which shard it goes to.
GRAM = 32
#: Strings that a segment of the text covers, at most.
SEGMENT = 512
#: Bytes of texts that are cut into segments at once: what numpy makes of them should stay in a core's cache.
CUT_BYTES = 1 << 17
#: Bytes of texts whose segments a task holds at once.
GIVEN_BYTES = 1 << 20
#: Bytes that are put into one suffix array; the segments of a key that have more are split.
SHARD_BYTES = 400_000
#: By how many places of its gram the strings of a split key may differ, split after split.
SPLITS = (24, 4, 1)

RUNS = "array<struct<first:bigint,last:bigint>>"
_RUN = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def segments(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Key, two hashes of the bytes, row, first byte in the row, number of strings, and whether its key recurs, of every segment.

    A string of width bytes has as key the least hash among its grams, so equal strings have equal keys wherever they
    stand. A segment is a run of strings that start one byte apart and have one key. Its own strings can only equal one
    another if the gram with that hash stands at several places in it: the first in its first string isn't the last in
    its last.
    """
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    total = len(data)
    if total < width:
        return empty
    prefix = prefix_hash(data)
    grams = span_hash(prefix, np.arange(total + 1 - gram), np.arange(gram, total + 1))
    span = width - gram + 1
    least = _least(grams, span)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: total - width + 1]
    start = np.flatnonzero(np.arange(total - width + 1) + width <= offsets[1:][row])
    if not len(start):
        return empty
    least, row = least[start], row[start]
    new = np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    place = np.arange(len(start)) - np.repeat(first, np.diff(np.r_[first, len(start)]))
    first = np.flatnonzero(new | (place % SEGMENT == 0))
    n = np.diff(np.r_[first, len(start)])
    begin = start[first]
    content = _contents(data, prefix, begin, begin + n + width - 1)
    key = least[first]
    # of the keys that stand at several places at all, those that do so in their segment
    again = np.zeros(len(key), bool)
    ordered = np.sort(grams)
    maybe = np.flatnonzero(np.isin(key, ordered[1:][ordered[1:] == ordered[:-1]]))
    steps = np.arange(span)
    for a in range(0, len(maybe), 4096):
        own = maybe[a : a + 4096]
        at = begin[own, None] + steps
        left = (grams[at] == key[own, None]).argmax(1)
        right = span - 1 - (grams[at + n[own, None] - 1] == key[own, None])[:, ::-1].argmax(1)
        again[own] = left != right + n[own] - 1
    return key, *content, row[first], begin - offsets[row[first]], n, again


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each span values that follow one another."""
    size = 1
    while size * 2 <= span:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (span - size)], x[span - size :]) if size < span else x


def _contents(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of data[start:end]."""
    return mix(span_hash(prefix, starts, ends) ^ np.uint64(0xA5A5)), span_hash(prefix_hash(data, True), starts, ends)


def _pieces(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """data[begin : begin + length] of each, as binary values."""
    ends = np.cumsum(length)
    if len(length) and ends[-1] >= 1 << 31:
        raise ValueError("more than 2 GB of segments in one batch")
    at = np.repeat(begin - (ends - length), length) + np.arange(int(length.sum()))
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data[at].tobytes())])


def _run_lists(marks: list[np.ndarray]) -> pa.Array:
    """The runs of marked places of each array, as lists of (first, last)."""
    firsts, lasts, sizes = [], [], [0]
    for m in marks:
        edge = np.diff(np.r_[False, m, False].astype(np.int8))
        firsts.append(np.flatnonzero(edge == 1))
        lasts.append(np.flatnonzero(edge == -1) - 1)
        sizes.append(sizes[-1] + len(firsts[-1]))
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, lasts)]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in flat], fields=list(_RUN)))


def _sorted_shards(strings: DataFrame, width: int, limit: int) -> DataFrame:
    """key, x, y and runs of repeated starts of strings(key, x, y, c, bytes) that come in order of key."""

    def judged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        seen: dict[tuple, int] = {}
        for i, one in enumerate(zip(*(table[c].to_pylist() for c in ("key", "x", "y")), strict=True)):
            seen.setdefault(one, i)
        table = table.take(pa.array(sorted(seen.values())))
        texts = table["bytes"].to_pylist()
        marks = repeated_starts(texts, width)
        for i, c in enumerate(table["c"].to_pylist()):
            if c > 1:  # the string stands for several
                marks[i][: len(texts[i]) - width + 1] = True
        return pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in ("key", "x", "y")), _run_lists(marks)], ["key", "x", "y", "runs"])

    def body(batches):
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                keys = batch.column(0).to_numpy()
                lengths = np.diff(text_bytes(batch.column(4))[1])
                over = int(np.searchsorted(size + np.cumsum(lengths), limit))
                # the shard ends where a key does
                cut = batch.num_rows
                if over < batch.num_rows:
                    change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                    change = change[change > over]
                    if size >= limit and held and held[-1].column(0)[-1].as_py() != keys[0]:
                        cut = 0
                    elif len(change):
                        cut = int(change[0])
                    else:
                        cut = None
                if cut is None or over >= batch.num_rows:
                    held.append(batch)
                    size += int(lengths.sum())
                    break
                if cut:
                    held.append(batch.slice(0, cut))
                yield judged(held)
                held, size = [], 0
                batch = batch.slice(cut)
        if held:
            yield judged(held)

    return strings.mapInArrow(body, f"key long, x long, y long, runs {RUNS}")


def _split(strings: DataFrame, width: int, gram: int, step: int) -> DataFrame:
    """The segments of strings(key, x, y, g, c, bytes) cut anew, into ones with a key of more bytes.

    A string has its gram g first at some place; strings of one text whose first g is the same, at places that differ
    by less than step, are a new segment, and the bytes that they all have are hashed to its key. Equal strings have
    their gram at equal places and so equal keys; a step of 1 leaves one string a segment. Gives the old key, x and y,
    the new segment's first string in the old, and its key, x, y, g, c, n and bytes.
    """
    span = width - gram + 1

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(5))
        g = batch.column(3).to_numpy().view(np.uint64)
        rows, froms, keys, xs, ys, ns, begins = ([] for _ in range(7))
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            prefix = prefix_hash(own)
            n = len(own) - width + 1
            at = np.flatnonzero(span_hash(prefix, np.arange(len(own) + 1 - gram), np.arange(gram, len(own) + 1)) == g[i])
            starts = np.arange(n)
            place = at[np.searchsorted(at, starts)]
            group = (place - starts) // step
            first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (group[1:] != group[:-1])])
            last = np.r_[first[1:], n] - 1
            # what all strings with this place and group have in common, whether they are in the segment or not
            low = place[first] - group[first] * step
            high = place[first] - np.minimum(group[first] * step + step - 1, span - 1) + width
            keys.append(mix(span_hash(prefix, low, high) + group[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            x, y = _contents(own, prefix, first, last + width)
            xs.append(x)
            ys.append(y)
            rows.append(np.full(len(first), i))
            froms.append(first)
            ns.append(last - first + 1)
            begins.append(first + offsets[i])
        rows, froms, ns, begins = (np.concatenate(v or [np.zeros(0, np.int64)]) for v in (rows, froms, ns, begins))
        keys, xs, ys = (np.concatenate(v or [np.zeros(0, np.uint64)]).view(np.int64) for v in (keys, xs, ys))
        old = [batch.column(c).take(pa.array(rows)) for c in range(5)]
        return pa.RecordBatch.from_arrays([old[0], old[1], old[2], pa.array(froms), pa.array(keys), pa.array(xs), pa.array(ys), old[3], old[4], pa.array(ns), _pieces(data, begins, ns + width - 1)], ["key", "x", "y", "from", "key2", "x2", "y2", "g", "c", "n", "bytes"])

    return map_arrow(strings, cut, "key long, x long, y long, from long, key2 long, x2 long, y2 long, g long, c long, n long, bytes binary")


def _judged(strings: DataFrame, sizes: DataFrame, work: Workspace, width: int, gram: int, limit: int, splits: tuple[int, ...]) -> DataFrame:
    """key, x, y and runs of repeated starts of strings(key, x, y, g, c, bytes), distinct segments that stand for c; sizes: key and its bytes.

    Keys of up to limit bytes go to suffix arrays. The segments of others are split, which is done again as long as that
    leaves too much under one key; at a step of 1 a key's strings are all equal, and no more than one is left.
    """
    row = sizes.agg(F.sum("size"), F.max("size")).first()
    volume = row[0] or 0
    shards = max(1, -(-volume // (8 << 20)), min(int(work.spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // (1 << 19))))
    if not splits or (row[1] or 0) <= limit:
        calm = strings
    else:
        calm = strings.join(sizes.where(F.col("size") <= limit).select("key"), "key", "left_semi")
    out = work.save(_sorted_shards(calm.select("key", "x", "y", "c", "bytes").repartition(int(shards), "key").sortWithinPartitions("key"), width, limit), "judged")
    if not splits or (row[1] or 0) <= limit:
        return out
    hot = strings.join(sizes.where(F.col("size") > limit).select("key"), "key", "left_semi").dropDuplicates(["key", "x", "y"])
    parts = work.save(_split(hot.select("key", "x", "y", "g", "c", "bytes"), width, gram, splits[0]), "parts")
    one = parts.groupBy("key2", "x2", "y2").agg(F.sum("c").alias("c"), F.any_value("g").alias("g"), F.any_value("n").alias("n"), F.any_value("bytes").alias("bytes"))
    one = work.save(one, "split")
    keys = work.save(one.groupBy("key2").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") + width - 1).alias("size")).where("all > 1"), "keys")
    equal = one.join(keys.where("kinds = 1").select("key2"), "key2", "left_semi").select("key2", "x2", "y2", F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("n") - 1).alias("last"))).alias("runs"))
    several = one.join(keys.where("kinds > 1").select("key2"), "key2", "left_semi").select(F.col("key2").alias("key"), F.col("x2").alias("x"), F.col("y2").alias("y"), "g", "c", "bytes")
    below = _judged(several, keys.where("kinds > 1").select(F.col("key2").alias("key"), "size"), work, width, gram, limit, splits[1:])
    found = equal.unionByName(below.select(F.col("key").alias("key2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "runs")).where(F.size("runs") > 0)
    shifted = F.transform("runs", lambda r: F.struct((r["first"] + F.col("from")).alias("first"), (r["last"] + F.col("from")).alias("last")))
    back = parts.drop("bytes").join(found, ["key2", "x2", "y2"]).groupBy("key", "x", "y").agg(F.flatten(F.collect_list(shifted)).alias("runs"))
    return out.unionByName(work.save(back, "judged"))


def find(docs: DataFrame, width: int = WIDTH, limit: int = SHARD_BYTES, text_col: str = "text", name: str = "repeats", splits: tuple[int, ...] = SPLITS) -> tuple[DataFrame, Workspace]:
    """The columns of docs, and `name`: the runs of places at which a repeated string of width bytes starts; the tables on the way.

    A string is repeated if its bytes also start anywhere else, in the same text or another, overlaps included. Places
    are bytes of the UTF-8 text.

    Strings are dealt to shards by the least hash among their grams; neighbours with the same stay together in segments.
    A key that occurs once, with its gram at one place, holds no repeat and is done. Segments with equal bytes, by two
    64-bit hashes, are put together, with their number: where that is all a key has, each of their strings is repeated.
    The others are sorted in suffix arrays, several keys in one, and common prefixes with neighbours of width bytes or
    more are the repeats. A key with more than `limit` bytes of different segments, as that of a common phrase, has them
    split by more of their bytes and sorted in the same way, so a shard is bounded. Texts are shuffled twice, all else
    is hashes and places.

    Texts with equal bytes, by two 64-bit hashes, are one text, repeated rows too. Null texts and those under width bytes
    have none; an empty table gives no rows. A column called as `name` says is replaced, other columns stay.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    kept = docs.drop(name)
    text = F.col(f"`{text_col}`").cast("string")
    owner_of = F.coalesce(F.xxhash64("doc_id") if "doc_id" in docs.columns else F.lit(0), F.lit(0))
    texts = docs.select(F.xxhash64(text).alias("f"), F.xxhash64(F.lit(7), text).alias("h"), owner_of.alias("d"), text.alias("text")).where(F.octet_length("text") >= width)

    kinds = (np.int64, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, bool)

    def cut(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            f, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for x, y in runs(offsets, GIVEN_BYTES):  # what is found in so many bytes is given out before the next
                parts = []
                for a, b in runs(offsets[x : y + 1], CUT_BYTES):
                    own = offsets[x + a : x + b + 1]
                    key, c1, c2, row, start, n, again = segments(data[own[0] : own[-1]], own - own[0], width)
                    row += x + a
                    parts.append((key.view(np.int64), c1.view(np.int64), c2.view(np.int64), f[row], h[row], start, n, again))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*parts), kinds, strict=True)], ["key", "x", "y", "f", "h", "start", "n", "again"])

    places = work.save(texts.select("f", "h", "text").mapInArrow(cut, "key long, x long, y long, f long, h long, start int, n int, again boolean"), "places")
    ends = [fn(c).alias(f"{c}{k}") for c in ("x", "y") for k, fn in enumerate((F.min, F.max))]
    more = places.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.max("again").alias("again"), *ends).where((F.col("all") > 1) | F.col("again"))
    more = more.select("key", ((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")) | (F.col("all") == 1)).alias("several"))
    found = work.save(places.drop("again").join(more, "key"), "found")
    work.drop("places")
    at = F.struct("f", "h", "start", "n")
    several = work.save(found.where("several").groupBy("key", "x", "y").agg(F.count(F.lit(1)).alias("c"), F.min(at).alias("at")).select("key", "x", "y", "c", "at.*"), "several")
    # the bytes of one of each
    owner = texts.groupBy("f", "h").agg(F.min("d").alias("d"))
    wanted = several.groupBy("f", "h").agg(F.collect_list(F.struct("start", "n", "key", "x", "y", "c")).alias("w")).join(owner, ["f", "h"])

    def taken(batches):
        done: set[tuple[int, int]] = set()  # of rows that are repeated, one gives its bytes
        for batch in batches:
            ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            fresh = []
            for i in ids:
                fresh.append(i not in done)
                done.add(i)
            whole = batch.filter(pa.array(fresh, pa.bool_()))
            for a, b in runs(text_bytes(whole.column(2))[1], GIVEN_BYTES):
                part = whole.slice(a, b - a)
                data, offsets = text_bytes(part.column(2))
                lists = part.column(3)
                flat, row = lists.flatten(), np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                start, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                key, x, y, c = (flat.field(i) for i in (2, 3, 4, 5))
                yield pa.RecordBatch.from_arrays([key, x, y, key, c, _pieces(data, offsets[row] + start, n + width - 1)], ["key", "x", "y", "g", "c", "bytes"])

    strings = texts.join(wanted, ["f", "h", "d"]).select("f", "h", "text", "w").mapInArrow(taken, "key long, x long, y long, g long, c long, bytes binary")
    strings = work.save(strings, "strings")
    sizes = work.save(several.groupBy("key").agg(F.sum(F.col("n") + width - 1).alias("size")), "sizes")
    verdicts = _judged(strings, sizes, work, width, GRAM, limit, splits)
    work.drop("strings", "sizes", "several", "parts", "split", "keys")
    first = F.col("start").cast("long")
    whole = found.where("NOT several").select("f", "h", F.array(F.struct(first.alias("first"), (first + F.col("n") - 1).alias("last"))).alias("r"))
    shifted = F.transform("runs", lambda r: F.struct((first + r["first"]).alias("first"), (first + r["last"]).alias("last")))
    parts = found.where("several").select("key", "x", "y", "f", "h", "start").join(verdicts.where(F.size("runs") > 0), ["key", "x", "y"]).select("f", "h", shifted.alias("r"))
    # a text's places come once for each copy of it, and are put together map-side
    spans = whole.unionByName(parts).groupBy("f", "h").agg(F.array_sort(F.flatten(F.collect_set("r"))).alias("r"))
    spans = work.save(spans, "spans")
    work.drop("found", "judged")
    f, h, r = (unused_name(docs.columns, c) for c in ("f", "h", "r"))
    right = spans.select(F.col("f").alias(f), F.col("h").alias(h), F.col("r").alias(r))
    own = kept.select(*[F.col(f"`{c}`") for c in kept.columns])
    out = own.join(right, (F.xxhash64(text) == F.col(f)) & (F.xxhash64(F.lit(7), text) == F.col(h)), "left")
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(r).alias(name)), work


def spans_of(row_runs, width: int) -> list[tuple[int, int]]:
    """The byte ranges [start, end) that strings starting in these runs cover, put together where they touch."""
    out: list[tuple[int, int]] = []
    for r in sorted((r["first"], r["last"] + width) for r in row_runs or ()):
        if out and r[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r[1]))
        else:
            out.append(r)
    return out


def without_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, cut back to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the bytes that repeated strings of width bytes cover, by columns as before; n_chars, if there, is anew.

    Of a character that a span covers in part, no byte goes. All rows stay, also those whose text is then empty; null
    texts stay null.
    """
    private = unused_name(docs.columns, "repeats")
    found, _ = find(docs, width, name=private)
    names = docs.columns
    at, last = names.index("text"), len(names)
    chars = names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns[:last])
        texts = columns[at].to_pylist()
        lists = batch.column(last).to_pylist()
        hit = [i for i, x in enumerate(lists) if x]
        if hit:
            counts = columns[chars].to_pylist() if chars is not None else None
            for i in hit:
                raw = texts[i].encode()
                texts[i] = without_spans(raw, whole_characters(raw, spans_of(lists[i], width))).decode("utf-8", "replace")
                if counts:
                    counts[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if counts:
                columns[chars] = pa.array(counts, columns[chars].type)
        return pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(lambda batches: map(body, batches), schema)


def query(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256, of what is left when all repeats are removed."""
    found, _ = find(docs.select("doc_id", F.col("text").cast("string").alias("text")), width)

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        raw = memoryview(data.tobytes())
        removed, n_spans, digests = [], [], []
        for i, runs_ in enumerate(batch.column(2).to_pylist()):
            own = raw[offsets[i] : offsets[i + 1]]
            spans = spans_of(runs_, width)
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(own[at:a])
                at = b
            digest.update(own[at:])
            removed.append(sum(b - a for a, b in spans))
            n_spans.append(len(spans))
            digests.append(digest.hexdigest())
        return pa.record_batch({"doc_id": batch.column(0), "n_bytes": np.diff(offsets), "n_removed": np.array(removed, np.int64), "n_spans": np.array(n_spans, np.int64), "kept_sha256": pa.array(digests, pa.string())})

    return map_arrow(found.select("doc_id", "text", "repeats"), body, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: op8_suffix_dedup by the md5 of the 200 bytes at every place.
SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS raw FROM documents
), sized AS (
  SELECT doc_id, r, hex(raw) AS x, octet_length(raw) AS n FROM docs
), pieces AS (
  SELECT r, c, n, substr(x, 2 * c + 1, 910) AS part FROM (SELECT r, x, n, unnest(range(0, n - 199, 256)) AS c FROM sized)
), places AS (
  SELECT r, c + i AS p, md5(substr(part, 2 * i + 1, 400)) AS h FROM (SELECT r, c, part, unnest(range(0, least(256, n - 199 - c))) AS i FROM pieces)
), often AS (
  SELECT h FROM places GROUP BY h HAVING count(*) > 1
), starts AS (
  SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM places SEMI JOIN often USING (h)
), numbered AS (
  SELECT r, p, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM starts
), spans AS (
  SELECT r, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY r, k
), cut AS (
  SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n FROM spans GROUP BY r
)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(c.a), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN c.r IS NULL THEN d.x ELSE array_to_string(list_transform(range(0, len(c.a) + 1),
    lambda i: substr(d.x, 2 * coalesce(c.b[i], 0) + 1, 2 * (coalesce(c.a[i + 1], d.n) - coalesce(c.b[i], 0)))), '') END)) AS kept_sha256
FROM sized d LEFT JOIN cut c ON c.r = d.r"""
