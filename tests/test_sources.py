"""Formats: round trips, dialects, and files that are no such."""

import math

import pytest

from sparkweave.functions.casts import Kind, convert, convertible
from sparkweave.functions.special import lgamma1p, log_q
from sparkweave.sources import binary, dot, edgelist, graphml
from sparkweave.sources.document import Column, Document, FormatError, from_graph, read_edges, read_graph, to_graph, write_bytes

EDGES = [(0, 1), (0, 1), (1, 2), (2, 2), (3, 0), (3, 4), (0, 4), (4, 3)]
SCALARS = {Kind.BOOL: [0, 1, 255], Kind.INT16: [-32768, 5, 32767], Kind.INT32: [-1, 0, 2**31 - 1], Kind.INT64: [-(2**63), 0, 2**63 - 1], Kind.DOUBLE: [-0.0, 5e-324, 1e300], Kind.LONG_DOUBLE: [bytes(range(16)), bytes(16), b"\xff" * 16], Kind.STRING: ["", "a,b\\ é", "<&>\"'"], Kind.OBJECT: [b"", b"\x80", b"abc"]}


def document(kinds=Kind):
    columns = []
    for kind in kinds:
        values = SCALARS.get(kind) or [[], SCALARS[kind.element], SCALARS[kind.element][:1]]
        cycle = lambda n, v=values: [v[i % 3] for i in range(n)]
        columns += [Column(f"{kind.name} {d}", d, kind, cycle(n)) for d, n in (("graph", 1), ("vertex", 5), ("edge", 8))]
    return Document(5, EDGES, True, columns, "a note")


def by_ends(doc):
    order = sorted(range(len(doc.edges)), key=lambda i: (doc.edges[i][0], i))
    return [doc.edges[i] for i in order], {(c.name, c.domain): [c.values[i] for i in order] if c.domain == "edge" else c.values for c in doc.columns}


def test_binary_round_trip():
    doc = document()
    again = binary.parse(b"".join(binary.render(doc)))
    assert by_ends(doc) == (again.edges, {(c.name, c.domain): c.values for c in again.columns}) and again.comment == "a note"
    assert math.copysign(1, again.column("DOUBLE graph", "graph").values[0]) == -1


def test_binary_files_that_end_early():
    raw = b"".join(binary.render(document([Kind.INT32, Kind.STRING])))
    for n in range(len(raw)):
        with pytest.raises(FormatError):
            binary.parse(raw[:n])
    assert [binary.index_width(n) for n in (0, 255, 256, 65535, 65536, 2**32)] == [1, 1, 2, 2, 4, 8]


def test_graphml_round_trip():
    # of long doubles the text has the number, so those whose bits make up one; of vectors of texts no empty one at the end
    own = {Kind.LONG_DOUBLE: [graphml.long_double(x) for x in ("0x1.8p-3", "-inf", "0.1")]}
    doc = document([k for k in Kind if not k.element or k is not Kind.VECTOR_STRING])
    for c in doc.columns:
        if (c.kind.element or c.kind) in own:
            swap = dict(zip(SCALARS[Kind.LONG_DOUBLE], own[Kind.LONG_DOUBLE]))
            c.values = [[swap[x] for x in v] if c.kind.element else swap[v] for v in c.values]
    again = graphml.parse(b"".join(graphml.render(doc)))
    assert again.edges == doc.edges and again.directed
    for c in again.columns:
        own = doc.column(c.name, c.domain)
        assert c.kind is own.kind and c.values == own.values


def test_numbers_of_graphml():
    d, b = graphml.long_double, lambda x: graphml.long_double_text(graphml.long_double(x))
    assert d("1.5") == d("0x1.8p0") == d("0xcp-3") and b("1.5") == "0xcp-3" and b("0") == "0x0p+0" and b("-0.0") == "-0x0p+0"
    assert b("inf") == "inf" and b("-Infinity") == "-inf" and b("nan") == "nan" and d(b("1e300")) == d("1e300") and d(b("5e-324")) == d("5e-324")
    decode = graphml.decode
    assert decode(Kind.DOUBLE, "0x1p-1") == 0.5 and decode(Kind.DOUBLE, "1.5") == 1.5 and decode(Kind.INT16, "-32768") == -32768 and decode(Kind.BOOL, "true") == 1
    for kind, text in ((Kind.INT64, "1_000"), (Kind.INT16, "99999"), (Kind.DOUBLE, "1_0"), (Kind.LONG_DOUBLE, "0x"), (Kind.LONG_DOUBLE, "--1"), (Kind.INT32, "1.5"), (Kind.BOOL, "yes")):
        with pytest.raises(ValueError):
            decode(kind, text)


def test_edge_names_and_domains_of_graphml():
    text = b"""<graphml><key id="k" for="edge" attr.name="w" attr.type="double"/><graph edgedefault="directed"><node id="n0"/><node id="n1"/>
    <edge id="x" source="n0" target="n1"><data key="k">1.5</data></edge></graph></graphml>"""
    doc = graphml.parse(text)
    assert doc.column(graphml.EDGE_ID, "edge").values == ["x"] and doc.column("w", "edge").values == [graphml.long_double("1.5")]
    again = graphml.parse(b"".join(graphml.render(doc)))
    assert again.column(graphml.EDGE_ID, "edge").values == ["x"] and again.column("w", "edge").values == doc.column("w", "edge").values
    with pytest.raises(FormatError, match="line"):
        graphml.parse(text.replace(b'<node id="n1"/>', b'<node id="n1"><data key="k">1</data></node>'))


def test_graphml_defaults_and_errors():
    text = b"""<graphml><key id="k" for="node" attr.name="w" attr.type="int"><default>7</default></key>
    <graph edgedefault="undirected"><node id="b"/><node id="a"><data key="k">3</data></node><edge source="a" target="c"/></graph></graphml>"""
    doc = graphml.parse(text)
    assert doc.column("w", "vertex").values == [7, 3, 7] and doc.edges == [(1, 2)] and not doc.directed
    assert doc.column(graphml.VERTEX_ID, "vertex").values == ["b", "a", "c"]
    for bad in (text.replace(b'key="k"', b'key="x"'), text.replace(b'"int"', b'"integer"'), text[:-9], text.replace(b">3<", b">x<")):
        with pytest.raises(FormatError, match="line"):
            graphml.parse(bad)


def test_dot():
    text = """strict digraph "g" { graph [label="a" + "b"]; node [shape=box]; z; a -> {b c} -> z [w=1];
      subgraph s { y } /* note */ a -> a; a -> b; // again
      "q u":port:n -> y; h [label=<x<b>y</b>>] }"""
    doc = dot.parse(text.encode())
    names = doc.column(dot.VERTEX_NAME, "vertex").values
    assert names == ["a", "b", "c", "h", "q u", "y", "z"]
    assert [(names[a], names[b]) for a, b in doc.edges] == [("a", "b"), ("a", "c"), ("b", "z"), ("c", "z"), ("q u", "y")]
    assert doc.column("label", "graph").values == ["ab"] and doc.column("w", "edge").values == ["1"] * 4 + [""]
    again = dot.parse(b"".join(dot.render(doc)))
    assert again.edges == doc.edges and {(c.name, c.domain): c.values for c in again.columns} == {(c.name, c.domain): c.values for c in doc.columns if c.domain != "graph"}
    for bad in ("graph { a -> b }", "digraph { a -> }", "digraph { a", "nothing", "graph {} x"):
        with pytest.raises(FormatError):
            dot.parse(bad.encode())


def test_edge_lists():
    doc = edgelist.parse("a,c\nb,a\nc,d\na,b\n", symbolic=True)
    assert doc.columns[0].values == ["a", "c", "b", "d"] and doc.edges == [(0, 1), (2, 0), (1, 3), (0, 2)]
    doc = edgelist.parse('﻿"x,\n1", " y ""z"" ",more\r\n\r\n a"b ,c\r', symbolic=True)
    assert doc.columns[0].values == ["x,\n1", '" y ""z"" "', 'a"b', "c"]
    assert edgelist.parse("source;target\n3;1\n", ";", header=True).n == 4
    for bad in ("1\n", "1,x\n", '"1,2\n'):
        with pytest.raises(FormatError, match="line 1"):
            edgelist.parse(bad)


@pytest.mark.parametrize("module", [binary, graphml, dot])
def test_files_of_frames(spark, tmp_path, module):
    g = to_graph(spark, Document(3, [(0, 1), (2, 0)], True, [Column("name", "vertex", Kind.STRING, ["x", "y", "z"]), Column("w", "edge", Kind.STRING, ["1", "2"])]))
    path = f"file://{tmp_path}/g"
    write_bytes(spark, path, module.render(from_graph(g)))
    again = read_graph(spark, path, module.parse)
    assert sorted((r.src, r.dst, r.w) for r in again.edges.collect()) == [(0, 1, "1"), (2, 0, "2")]
    assert [r["name"] for r in again.vertices.orderBy("id").collect()] == ["x", "y", "z"]
    assert read_edges(spark, path, module.parse).count() == 2


@pytest.mark.parametrize("module", [binary, dot, graphml])
def test_files_pass_by_the_driver(spark, tmp_path, monkeypatch, module):
    """The files are those of documents, with all kinds, and the driver neither makes nor parses one."""
    kinds = [k for k in Kind if k.element or k is not Kind.LONG_DOUBLE] if module is binary else [Kind.INT32, Kind.STRING, Kind.DOUBLE]
    doc = document(kinds)
    doc.columns, doc.comment = [c for c in doc.columns if c.domain != "graph" and c.kind is not Kind.VECTOR_LONG_DOUBLE], ""
    g = to_graph(spark, doc)
    whole = b"".join(module.render(from_graph(g)))
    for name in ("parse", "render"):
        monkeypatch.delattr(module, name)
    module.write(spark, g, f"file://{tmp_path}/g")
    assert (tmp_path / "g").read_bytes() == whole
    again = module.read(spark, f"file://{tmp_path}/g")
    rows = lambda df, key: [tuple(r) for r in df.orderBy(key).collect()]
    order = g.edges.orderBy("src", "edge_id") if module is binary else g.edges.orderBy("edge_id")
    if module is binary:
        assert again.edges.schema == g.edges.schema and rows(again.vertices, "id") == rows(g.vertices, "id")
        assert [tuple(r)[1:] for r in again.edges.orderBy("edge_id").collect()] == [tuple(r)[1:] for r in order.collect()]
    else:
        monkeypatch.undo()
        parsed = to_graph(spark, module.parse(whole))
        assert again.edges.schema == parsed.edges.schema and again.vertices.schema == parsed.vertices.schema
        assert rows(again.vertices, "id") == rows(parsed.vertices, "id") and rows(again.edges, "edge_id") == rows(parsed.edges, "edge_id")


def test_graphml_in_pieces():
    text = b"""<graphml><key id="k" for="all" attr.name="w" attr.type="int"><default>7</default></key>
    <graph edgedefault="directed"><node id="b"/><edge id="x" source="a" target="c"><data key="k">3</data></edge><edge source="a" target="b"/></graph></graphml>"""
    whole = [x for rows in graphml._stream([text]) for x in rows]
    assert [x[1:] for x in whole if x[0] == "edge"] == [(0, 1, 2, "x", {"w": "3"}), (1, 1, 0, "e1", {"w": "7"})]
    assert all([x for rows in graphml._stream([text[:at], text[at:]]) for x in rows] == whole for at in range(len(text)))


def test_dot_in_pieces():
    text = 'strict digraph "g" {\n# a "note\n a -> {b; c} /* x\n y */ -> "d\n" + "e" [w=.5, l=<<b>\n</b>>];\n// -\n "f" -> a:p; b -> a -> b }\n'
    assert len(list(dot._stream([text.encode()]))[0]) == 6
    for at in range(len(text)):
        for cut in (1, 5):
            pieces = [text[:at], text[at : at + cut], text[at + cut :]]
            assert list(dot._joined(dot._lexed(pieces))) == dot.tokens(text)
    assert sum(list(dot._stream([text.encode()], 1)), []) == sum(list(dot._stream([c.encode() for c in text.splitlines(True)])), [])


def test_plain_edge_lists(spark, tmp_path):
    edges = spark.createDataFrame([(0, 5, 1), (1, 2, 3)], "edge_id long, src long, dst long")
    edgelist.write(edges, str(tmp_path / "e"), header=True)
    assert sorted(map(tuple, edgelist.read_plain(spark, str(tmp_path / "e"), header=True).collect())) == [(2, 3), (5, 1)]


def test_short_columns_are_refused(spark):
    with pytest.raises(FormatError):
        to_graph(spark, Document(2, [], True, [Column("x", "vertex", Kind.INT32, [1])]))


def test_conversions(spark):
    from pyspark.sql import functions as F

    def one(value, sql, source, target):
        return spark.createDataFrame([(value,)], f"x {sql}").select(convert(F.col("x"), source, target).alias("y")).first().y

    assert one(70000, "bigint", Kind.INT64, Kind.INT16) == 4464 and one(-1, "bigint", Kind.INT64, Kind.BOOL) == 255
    assert one(1e30, "double", Kind.DOUBLE, Kind.INT32) == 2**31 - 1 and one(float("nan"), "double", Kind.DOUBLE, Kind.INT64) == 0
    assert one(-7.9, "double", Kind.DOUBLE, Kind.INT16) == -7
    assert one("300", "string", Kind.STRING, Kind.BOOL) == 44 and one(" 5 ", "string", Kind.STRING, Kind.INT32) is None
    assert one("1e3", "string", Kind.STRING, Kind.DOUBLE) == 1000 and one("1x", "string", Kind.STRING, Kind.DOUBLE) is None
    assert [one(v, "double", Kind.DOUBLE, Kind.STRING) for v in (1.0, 0.5, float("inf"), float("nan"))] == ["1", "0.5", "inf", "nan"]
    assert one([1.5, -2.5], "array<double>", Kind.VECTOR_DOUBLE, Kind.VECTOR_INT32) == [1, -2]
    assert convertible(Kind.INT16, Kind.STRING) and not convertible(Kind.LONG_DOUBLE, Kind.DOUBLE) and not convertible(Kind.INT32, Kind.VECTOR_INT32)
    assert Kind.of("vector<string>").element is Kind.STRING


def test_special_functions(spark):
    from pyspark.sql import functions as F

    values = [0.0, 0.5, 1.0, 2.0, 9.5, 100.0, 1e6]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", lgamma1p(F.col("x")).alias("y")).collect()
    for r in rows:
        assert r.y == pytest.approx(math.lgamma(r.x + 1), rel=1e-12, abs=1e-13)
    counts = {(5, 5): 7, (6, 2): 4, (10, 10): 42, (0, 3): 1}
    for (n, k), p in counts.items():
        assert log_q(n, k) == pytest.approx(math.log(p))


def test_streamed_degrees(spark, tmp_path):
    from sparkweave.streaming.degrees import degrees

    spark.createDataFrame([(0, 1), (0, 0)], "src long, dst long").write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema("src long, dst long").parquet(f"{tmp_path}/in/*")
    q = degrees(stream).writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("streamed").collect())) == [(0, 2, 1, 3), (1, 0, 1, 1)]
