"""Shared pieces: vectorised tokenising and hashing of Arrow text columns, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handled in runs of about this many bytes, which bounds the memory of a task; a longer text is a run alone.
CHUNK_BYTES = 1 << 20

#: Bytes that part words: space and \t \n \v \f \r. All are ASCII, so words can be cut out of UTF-8 bytewise.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER_CODE = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- text as bytes


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the n + 1 offsets of its values; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose bytes together stay within limit, or that are one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES * 2)
        have = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            m = min(done, size - done)
            have[done : done + m] = have[:m] * np.uint64(step)
            done, step = done * 2, step * step % (1 << 64)
        if size <= CHUNK_BYTES * 8:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray, other: bool = False) -> np.ndarray:
    """Running polynomial hash of all prefixes; see span_hash. other: with other codes of the bytes, for a second hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_OTHER_CODE if other else _BYTE_CODE)[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(_BASE_INVERSE, len(prefix))[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def string_hash(text: str | bytes) -> int:
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return int(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])


# ---------------------------------------------------------------- Arrow functions


def map_arrow(df: DataFrame, body: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """mapInArrow of a function from one batch to one batch."""

    def each(batches):
        for batch in batches:
            yield body(batch)

    return df.mapInArrow(each, schema)


def unused_name(columns: list[str], name: str) -> str:
    """name, with underscores put before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_columns(df: DataFrame, new: str, body: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df without columns by the new names, and the new ones, which body makes of each batch of the others."""
    added = T._parse_datatype_string(new)
    kept = df.drop(*added.names)
    names = [*kept.columns, *added.names]
    return map_arrow(kept, lambda b: pa.RecordBatch.from_arrays([*b.columns, *body(b)], names), T.StructType([*kept.schema.fields, *added.fields]))


def kept_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of df for which keep is true; no column is added, so none can clash."""
    return map_arrow(df, lambda b: b.filter(pa.array(keep(b), pa.bool_())), df.schema)


# ---------------------------------------------------------------- the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where that is unset, a local one in local mode, as in tests, else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="sparkweave-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


class Workspace:
    """Tables written to the shared folder to cut lineage; what is left of them goes with drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/sparkweave-{uuid.uuid4().hex}", {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, when nothing that is still to run reads them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            for path in self.paths.pop(name, []):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def fold(column: str = "doc_id"):
    """crc32 of an id written as text, as the folds of the contracts take it; null ids fall in no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
