"""What graph files hold, and how it becomes DataFrames: a file is read by one task, as its formats can't be split."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import Kind
from ..graph import Graph
from ..plans.superstep import Loop


class FormatError(ValueError):
    """A file isn't of its format; the message says where."""


@dataclass
class Column:
    """A property: of the graph, its vertices or its edges; values by id, of the graph one."""

    name: str
    domain: str
    kind: Kind
    values: list


@dataclass
class Document:
    n: int
    edges: list[tuple[int, int]]
    directed: bool = True
    columns: list[Column] = field(default_factory=list)
    comment: str = ""

    def column(self, name: str, domain: str) -> Column | None:
        return next((c for c in self.columns if (c.name, c.domain) == (name, domain)), None)

    def check(self) -> None:
        """Ends are vertices, and columns have a value for each slot."""
        if any(not (0 <= a < self.n and 0 <= b < self.n) for a, b in self.edges):
            raise FormatError("an edge ends at no vertex")
        for c in self.columns:
            need = {"graph": 1, "vertex": self.n, "edge": len(self.edges)}[c.domain]
            if len(c.values) < need:
                raise FormatError(f"property {c.name} has {len(c.values)} values of {need}")


def _zero(kind: Kind):
    if kind.element:
        return []
    if kind.is_integer:
        return 0
    return {Kind.DOUBLE: 0.0, Kind.STRING: "", Kind.LONG_DOUBLE: bytes(16), Kind.OBJECT: b""}[kind]


def to_graph(spark: SparkSession, doc: Document) -> Graph:
    """A graph whose frames have the document's properties as columns; the kind stands in a column's metadata."""
    doc.check()

    def frame(ids: dict[str, list], domain: str) -> DataFrame:
        own = [c for c in doc.columns if c.domain == domain]
        schema = ", ".join([*(f"{k} long" for k in ids), *(f"`{c.name}` {c.kind.spark}" for c in own)])
        rows = list(zip(*ids.values(), *(c.values for c in own), strict=False))
        out = spark.createDataFrame(rows, schema)
        return out.select(*ids, *[F.col(f"`{c.name}`").alias(c.name, metadata={"kind": c.kind.label}) for c in own])

    ends = list(zip(*doc.edges, strict=True)) or [(), ()]
    g = Graph(frame({"id": list(range(doc.n))}, "vertex"), frame({"edge_id": list(range(len(doc.edges))), "src": ends[0], "dst": ends[1]}, "edge"), doc.n, len(doc.edges))
    return g if doc.directed else g.undirected()


_KINDS = {"smallint": Kind.INT16, "int": Kind.INT32, "bigint": Kind.INT64, "double": Kind.DOUBLE, "string": Kind.STRING, "array<smallint>": Kind.VECTOR_INT16, "array<int>": Kind.VECTOR_INT32, "array<bigint>": Kind.VECTOR_INT64, "array<double>": Kind.VECTOR_DOUBLE, "array<string>": Kind.VECTOR_STRING, "binary": Kind.OBJECT}


def columns_of(df: DataFrame, keys: list[str], domain: str) -> list[Column]:
    """The properties of a frame, without values."""
    columns = []
    for f in df.schema.fields:
        if f.name in keys:
            continue
        kind = Kind.of(f.metadata["kind"]) if "kind" in f.metadata else _KINDS.get(f.dataType.simpleString())
        if kind is None:
            raise FormatError(f"column {f.name} of type {f.dataType.simpleString()} is of no kind")
        columns.append(Column(f.name, domain, kind, []))
    return columns


def from_graph(g: Graph) -> Document:
    """The document of a graph with ids from 0 on; rows come to the one writer in order, a partition at a time."""
    base = g if g.direction == "undirected" else g

    def rows(df: DataFrame, keys: list[str], domain: str) -> tuple[list[tuple], list[Column]]:
        columns = columns_of(df, keys, domain)
        ends = []
        for r in df.orderBy(keys[0]).toLocalIterator():
            ends.append(tuple(r[k] for k in keys))
            for c in columns:
                c.values.append(_zero(c.kind) if r[c.name] is None else bytes(r[c.name]) if isinstance(r[c.name], bytearray) else r[c.name])
        return ends, columns

    vertices, vc = rows(base.vertices, ["id"], "vertex")
    edges, ec = rows(base.edges, ["edge_id", "src", "dst"], "edge")
    return Document(g.vertex_bound, [(a, b) for _, a, b in edges], g.direction != "undirected", [*vc, *ec])


def read_edges(spark: SparkSession, path: str, parse: Callable[[bytes], Document]) -> DataFrame:
    """(file, edge_id, src, dst) of the files under a path, each parsed by one task on the executors."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def body(batches):
        import pyarrow as pa

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc = parse(raw)
                ends = list(zip(*doc.edges, strict=True)) or [(), ()]
                m = len(doc.edges)
                yield pa.record_batch({"file": pa.array([name] * m, pa.string()), "edge_id": pa.array(range(m), pa.int64()), "src": pa.array(ends[0], pa.int64()), "dst": pa.array(ends[1], pa.int64())})

    return files.mapInArrow(body, "file string, edge_id long, src long, dst long")


def read_graph(spark: SparkSession, path: str, parse: Callable[[bytes], Document]) -> Graph:
    """The graph of one file, with its properties."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if len(rows) != 1:
        raise FormatError(f"{len(rows)} files at {path}")
    return to_graph(spark, parse(bytes(rows[0][0])))


def rendered(df: DataFrame, order: list[str], columns: list[Column], text: Callable[[dict[str, list]], bytes]) -> DataFrame:
    """The bytes of a frame's rows in order, made by the executors: text gets some rows as lists by column, without nulls."""
    zeros = {c.name: _zero(c.kind) for c in columns}

    def body(batches):
        import pyarrow as pa

        for batch in batches:
            rows = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for name, zero in zeros.items():
                rows[name] = [zero if x is None else x for x in rows[name]]
            yield pa.record_batch({"bytes": pa.array([text(rows)], pa.binary())})

    return df.orderBy(*order).mapInArrow(body, "bytes binary")


def write_parts(spark: SparkSession, path: str, parts: Iterable[bytes | DataFrame]) -> None:
    """One file of bytes and of frames of them; these pass through the driver a partition at a time, and are not kept there."""

    def each():
        for part in parts:
            if isinstance(part, bytes):
                yield part
            else:
                yield from (r[0] for r in part.toLocalIterator(prefetchPartitions=True))

    write_bytes(spark, path, each())


def checked(g: Graph) -> tuple[DataFrame, DataFrame, list[Column], list[Column]]:
    """What a file of the graph has: a row for every vertex slot, the edges, and the properties of both; checked as a document is."""
    n, spark = g.vertex_bound, g.vertices.sparkSession
    vc, ec = columns_of(g.vertices, ["id"], "vertex"), columns_of(g.edges, ["edge_id", "src", "dst"], "edge")
    if not g.edges.where((F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= n)).isEmpty():
        raise FormatError("an edge ends at no vertex")
    if vc and (have := g.vertices.count()) < n:
        raise FormatError(f"property {vc[0].name} has {have} values of {n}")
    return (g.vertices if vc else spark.range(n)), g.edges, vc, ec


def write_bytes(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """One file by any path that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()


def named_ends(vertices: DataFrame, edges: DataFrame, name: str, otherwise: str) -> DataFrame:
    """The edges with the names of their ends, __a and __b: by a column of the vertices, or else otherwise before the id."""
    if name not in vertices.columns:
        return edges.select("*", *[F.concat(F.lit(otherwise), F.col(k)).alias(to) for k, to in (("src", "__a"), ("dst", "__b"))])
    for k, to in (("src", "__a"), ("dst", "__b")):
        edges = edges.join(vertices.select(F.col("id").alias(k), F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(to)), k)
    return edges


@contextmanager
def format_errors():
    """Raises what a task said about a file's format as an error of this format."""
    try:
        yield
    except Exception as e:
        if said := re.search(r"FormatError: (.*)", str(e)):
            raise FormatError(said[1]) from e
        raise


def read_streamed(spark: SparkSession, path: str, stream: Callable, decode: Callable[[Kind, str], object]) -> Graph:
    """The graph of one text file, with its properties of vertices and edges.

    Lines are read in parallel and put in order; one task goes over them in pieces and writes the edges as it finds them,
    so that it holds the vertices alone. stream gets pieces of bytes and yields lists of rows (domain, at, src, dst, name,
    properties); a vertex has its number in src, and a last row of the domain shape, in name, what is known at the end.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    if len(found := lines.inputFiles()) != 1:
        raise FormatError(f"{len(found)} files at {path}")
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))

    def body(batches):
        import pyarrow as pa

        for rows in stream(b"\n".join(batch.column(0).to_pylist()) + b"\n" for batch in batches):
            domain, at, src, dst, name, props = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.record_batch({"domain": pa.array(domain, pa.string()), "at": pa.array(at, pa.int64()), "src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "name": pa.array(name, pa.string()), "props": pa.array([list(x.items()) for x in props], pa.map_(pa.string(), pa.string()))})

    loop = Loop(spark)
    with format_errors():
        rows = loop.fixed(lines.repartition(1).sortWithinPartitions("start", "at").select("line").mapInArrow(body, "domain string, at long, src long, dst long, name string, props map<string,string>"), "rows")
    shape = json.loads(rows.where("domain = 'shape'").first()["name"])

    def frame(df: DataFrame, ids: list[str], domain: str) -> DataFrame:
        own = [(name, Kind.of(kind), called) for d, name, kind, called in shape["columns"] if d == domain]

        def typed(batches):
            import pyarrow as pa

            for batch in batches:
                props = [dict(x) for x in batch.column("props").to_pylist()]
                names = batch.column("name").to_pylist()
                out = [batch.column(k) for k in ids]
                for name, kind, called in own:
                    of = kind.element or kind
                    kept = arrow_type(of.spark)
                    values = names if called else [decode(kind, p[name]) if name in p else _zero(kind) for p in props]
                    out.append(pa.array(values, pa.list_(kept) if kind.element else kept))
                yield pa.RecordBatch.from_arrays(out, [*ids, *(name for name, _, _ in own)])

        found = df.select(*ids, "name", "props").mapInArrow(typed, ", ".join([*(f"{k} long" for k in ids), *(f"`{name}` {kind.spark}" for name, kind, _ in own)]))
        return found.select(*ids, *[F.col(f"`{name}`").alias(name, metadata={"kind": kind.label}) for name, kind, _ in own])

    vertices, edges = rows.where("domain = 'vertex'"), rows.where("domain = 'edge'").withColumnRenamed("at", "edge_id")
    if shape["renumbered"]:
        number = vertices.select("at", F.col("src").alias("number"))
        for k in ("src", "dst"):
            edges = edges.join(number.withColumnRenamed("at", k), k).drop(k).withColumnRenamed("number", k)
    g = Graph(frame(vertices.select(F.col("src").alias("id"), "name", "props"), ["id"], "vertex"), frame(edges, ["edge_id", "src", "dst"], "edge"), shape["n"], shape["m"])
    return g if shape["directed"] else g.undirected()


def arrow_type(name: str):
    import pyarrow as pa

    return {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}[name]
