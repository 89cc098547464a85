"""The public binary graph format: adjacency lists and typed property columns."""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import Kind
from ..graph import Graph
from ..plans.superstep import Loop
from .document import Column, Document, FormatError, arrow_type, checked, format_errors, rendered, write_parts

# fixed values of the format
MAGIC = b"\xe2\x9b\xbe gt"
VERSION = 1
DOMAINS = ("graph", "vertex", "edge")
KINDS = tuple(Kind)
CODES = {Kind.BOOL: "B", Kind.INT16: "h", Kind.INT32: "i", Kind.INT64: "q", Kind.DOUBLE: "d", Kind.LONG_DOUBLE: "16s"}


def index_width(n: int) -> int:
    """Bytes of a vertex number in a graph of n."""
    return 1 if n < 1 << 8 else 2 if n < 1 << 16 else 4 if n < 1 << 32 else 8


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.order = raw, 0, "<"

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise FormatError(f"the file ends at byte {len(self.raw)}, {n} bytes were due from byte {self.at}")
        self.at += n
        return self.raw[self.at - n : self.at]

    def many(self, code: str, n: int) -> list:
        size = struct.calcsize("<" + code)
        raw = self.take(n * size)
        if code.endswith("s"):
            return [raw[i : i + size] for i in range(0, len(raw), size)]
        return list(struct.unpack(f"{self.order}{n}{code}", raw))

    def length(self) -> int:
        return self.many("Q", 1)[0]

    def blob(self) -> bytes:
        return self.take(self.length())

    def text(self) -> str:
        at = self.at
        try:
            return self.blob().decode()
        except UnicodeDecodeError as e:
            raise FormatError(f"no UTF-8 text at byte {at}") from e

    def values(self, kind: Kind, n: int) -> list:
        if kind in CODES:
            return self.many(CODES[kind], n)
        if kind is Kind.STRING:
            return [self.text() for _ in range(n)]
        if kind is Kind.OBJECT:
            return [self.blob() for _ in range(n)]
        return [self.values(kind.element, self.length()) for _ in range(n)]

    def head(self) -> tuple[str, bool, int]:
        """Comment, whether directed, number of vertices."""
        if self.take(len(MAGIC)) != MAGIC:
            raise FormatError("the magic is missing")
        version, big = self.take(1)[0], self.take(1)[0]
        if version != VERSION or big > 1:
            raise FormatError(f"version {version}, byte order {big}")
        self.order = ">" if big else "<"
        return self.text(), bool(self.take(1)[0]), self.length()

    def property(self) -> tuple[str, str, Kind]:
        """Domain, name and kind of the property that follows."""
        domain, name, kind = self.take(1)[0], self.text(), self.take(1)[0]
        if domain >= len(DOMAINS) or kind >= len(KINDS):
            raise FormatError(f"property {name}: domain {domain}, kind {kind}")
        return DOMAINS[domain], name, KINDS[kind]


def parse(raw: bytes) -> Document:
    """The document of a file's bytes. The i-th adjacency entry is edge i; objects stay bytes and are never unpickled."""
    r = _Reader(raw)
    comment, directed, n = r.head()
    code = {1: "B", 2: "H", 4: "I", 8: "Q"}[index_width(n)]
    edges = []
    for v in range(n):
        at = r.at
        for u in r.many(code, r.length()):
            if u >= n:
                raise FormatError(f"vertex {u} of {n} at byte {at}")
            edges.append((v, u))
    columns = []
    for _ in range(r.length()):
        domain, name, kind = r.property()
        columns.append(Column(name, domain, kind, r.values(kind, {"graph": 1, "vertex": n, "edge": len(edges)}[domain])))
    return Document(n, edges, directed, columns, comment)


def _encoded(kind: Kind, values: list) -> bytes:
    if kind in CODES:
        return b"".join(values) if kind is Kind.LONG_DOUBLE else struct.pack(f"<{len(values)}{CODES[kind]}", *values)
    if kind is Kind.STRING:
        return b"".join(struct.pack("<Q", len(b)) + b for b in (v.encode() for v in values))
    if kind is Kind.OBJECT:
        return b"".join(struct.pack("<Q", len(v)) + v for v in values)
    return b"".join(struct.pack("<Q", len(v)) + _encoded(kind.element, v) for v in values)


def render(doc: Document):
    """The file's bytes in parts. Edges stand by source, then id, and properties by domain: reading renumbers edges so."""
    doc.check()
    comment = (doc.comment or f"graph of {doc.n} vertices and {len(doc.edges)} edges, {'directed' if doc.directed else 'undirected'}").encode()
    yield MAGIC + bytes([VERSION, 0]) + struct.pack("<Q", len(comment)) + comment + bytes([doc.directed]) + struct.pack("<Q", doc.n)
    order = sorted(range(len(doc.edges)), key=lambda i: (doc.edges[i][0], i))
    out: list[list[int]] = [[] for _ in range(doc.n)]
    for i in order:
        out[doc.edges[i][0]].append(doc.edges[i][1])
    code = {1: "B", 2: "H", 4: "I", 8: "Q"}[index_width(doc.n)]
    for targets in out:
        yield struct.pack(f"<Q{len(targets)}{code}", len(targets), *targets)
    yield struct.pack("<Q", len(doc.columns))
    for c in sorted(doc.columns, key=lambda c: DOMAINS.index(c.domain)):
        values = [c.values[i] for i in order] if c.domain == "edge" else c.values[: 1 if c.domain == "graph" else doc.n]
        name = c.name.encode()
        yield bytes([DOMAINS.index(c.domain)]) + struct.pack("<Q", len(name)) + name + bytes([KINDS.index(c.kind)]) + _encoded(c.kind, values)


def _lists(n: int):
    """The bytes of adjacency lists: of a vertex, which has the edge_id -1, its number of edges, of an edge its target."""
    width = index_width(n)

    def text(rows):
        import numpy as np

        raw = np.array(rows["value"], "<u8").view(np.uint8).reshape(-1, 8)
        keep = np.arange(8) < np.where(np.array(rows["edge_id"]) < 0, 8, width)[:, None]
        return raw[keep].tobytes()

    return text


def write(spark: SparkSession, g: Graph, path: str) -> None:
    """The graph's file, as render has it of its document; rows are put in order and encoded by the executors."""
    vertices, edges, vc, ec = checked(g)
    n, m, directed = g.vertex_bound, edges.count(), g.direction != "undirected"
    comment = f"graph of {n} vertices and {m} edges, {'directed' if directed else 'undirected'}".encode()
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    lists = spark.range(n).join(degree, "id", "left").select(F.col("id").alias("src"), F.lit(-1).cast("long").alias("edge_id"), F.coalesce("k", F.lit(0)).alias("value"))
    lists = lists.unionByName(edges.select("src", "edge_id", F.col("dst").alias("value")))

    def parts():
        yield MAGIC + bytes([VERSION, 0]) + struct.pack("<Q", len(comment)) + comment + bytes([directed]) + struct.pack("<Q", n)
        yield rendered(lists, ["src", "edge_id"], [], _lists(n))
        yield struct.pack("<Q", len(vc) + len(ec))
        for c in [*vc, *ec]:
            name = c.name.encode()
            yield bytes([DOMAINS.index(c.domain)]) + struct.pack("<Q", len(name)) + name + bytes([KINDS.index(c.kind)])
            frame, order = (vertices, ["id"]) if c.domain == "vertex" else (edges, ["src", "edge_id"])
            yield rendered(frame.select(*order, F.col(f"`{c.name}`")), order, [c], lambda rows, c=c: _encoded(c.kind, rows[c.name]))

    write_parts(spark, path, parts())


def _skip(r: _Reader, kind: Kind, n: int) -> None:
    if kind in CODES:
        r.take(n * struct.calcsize("<" + CODES[kind]))
    else:
        for _ in range(n):
            r.take(r.length()) if kind in (Kind.STRING, Kind.OBJECT) else _skip(r, kind.element, r.length())


def _shape(raw: bytes) -> dict:
    """Numbers, properties and where they begin, of a file whose edges are gone over and not kept."""
    import numpy as np

    r = _Reader(raw)
    comment, directed, n = r.head()
    width, first, m, columns = index_width(n), r.at, 0, []
    for _ in range(n):
        at, k = r.at, r.length()
        targets = np.frombuffer(r.take(k * width), f"{r.order}u{width}")
        if k and (most := int(targets.max())) >= n:
            raise FormatError(f"vertex {most} of {n} at byte {at}")
        m += k
    for _ in range(r.length()):
        domain, name, kind = r.property()
        columns.append((domain, name, kind.label, r.at))
        _skip(r, kind, {"graph": 1, "vertex": n, "edge": m}[domain])
    return {"directed": directed, "n": n, "m": m, "order": r.order, "first": first, "columns": columns}


def _rows(raw: bytes, shape: dict, domain: str, size: int = 1 << 16):
    """Record batches of a domain's rows, so many at a time; a reader for each property goes along."""
    import numpy as np
    import pyarrow as pa

    def reader(at):
        r = _Reader(raw)
        r.at, r.order = at, shape["order"]
        return r

    own = [(name, Kind.of(kind), reader(at)) for d, name, kind, at in shape["columns"] if d == domain]
    n, m = shape["n"], shape["m"]
    if domain == "edge":
        width, lists, source, target = index_width(n), reader(shape["first"]), np.empty(m, np.int64), np.empty(m, np.int64)
        at = 0
        for v in range(n):
            k = lists.length()
            source[at : at + k] = v
            target[at : at + k] = np.frombuffer(lists.take(k * width), f"{shape['order']}u{width}")
            at += k
    for at in range(0, m if domain == "edge" else n, size):
        to = min(at + size, m if domain == "edge" else n)
        rows = {"edge_id" if domain == "edge" else "id": pa.array(range(at, to), pa.int64())}
        if domain == "edge":
            rows |= {"src": pa.array(source[at:to]), "dst": pa.array(target[at:to])}
        for name, kind, r in own:
            of = arrow_type((kind.element or kind).spark)
            rows[name] = pa.array(r.values(kind, to - at), pa.list_(of) if kind.element else of)
        yield pa.RecordBatch.from_arrays(list(rows.values()), list(rows))


def read(spark: SparkSession, path: str) -> Graph:
    """The graph of one file, with its properties of vertices and edges; a task of the executors holds the file's bytes and the edges' ends."""
    file = spark.read.format("binaryFile").load(path).select("content")

    def shapes(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0):
                yield pa.record_batch({"shape": pa.array([json.dumps(_shape(raw.as_py()))])})

    with format_errors():
        found = file.mapInArrow(shapes, "shape string").collect()
    if len(found) != 1:
        raise FormatError(f"{len(found)} files at {path}")
    shape, loop = json.loads(found[0][0]), Loop(spark)

    def frame(domain: str, ids: list[str]) -> DataFrame:
        own = [(name, Kind.of(kind)) for d, name, kind, _ in shape["columns"] if d == domain]

        def body(batches):
            for batch in batches:
                for raw in batch.column(0):
                    yield from _rows(raw.as_py(), shape, domain)

        rows = loop.fixed(file.mapInArrow(body, ", ".join([*(f"{k} long" for k in ids), *(f"`{name}` {kind.spark}" for name, kind in own)])), domain)
        return rows.select(*ids, *[F.col(f"`{name}`").alias(name, metadata={"kind": kind.label}) for name, kind in own])

    g = Graph(frame("vertex", ["id"]), frame("edge", ["edge_id", "src", "dst"]), shape["n"], shape["m"])
    return g if shape["directed"] else g.undirected()
