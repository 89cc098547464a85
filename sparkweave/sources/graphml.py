"""GraphML files."""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Callable, Iterable
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import SparkSession

from ..functions.casts import Kind
from ..graph import Graph
from ..plans.superstep import numbered
from .document import Column, Document, FormatError, _zero, checked, named_ends, read_streamed, rendered, write_parts

#: Kinds by attr.type. Fixed values; float is a double, and double a long double.
TYPES = {
    "boolean": Kind.BOOL,
    "short": Kind.INT16,
    "int": Kind.INT32,
    "long": Kind.INT64,
    "float": Kind.DOUBLE,
    "double": Kind.LONG_DOUBLE,
    "string": Kind.STRING,
    "vector_boolean": Kind.VECTOR_BOOL,
    "vector_short": Kind.VECTOR_INT16,
    "vector_int": Kind.VECTOR_INT32,
    "vector_long": Kind.VECTOR_INT64,
    "vector_float": Kind.VECTOR_DOUBLE,
    "vector_double": Kind.VECTOR_LONG_DOUBLE,
    "vector_string": Kind.VECTOR_STRING,
    "python_object": Kind.OBJECT,
}
#: Spellings of numbers and truth values. Fixed values.
DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)"
BOOLEANS = {"true": 1, "True": 1, "false": 0, "False": 0}
NAMES = {k: name for name, k in TYPES.items()}
VERTEX_ID, EDGE_ID = "_graphml_vertex_id", "_graphml_edge_id"


def _split(text: str) -> list[str]:
    """Parts of a vector: commas part them, and a backslash takes the next character as it is."""
    parts, part, i = [], [], 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            part.append(text[i + 1])
            i += 1
        elif text[i] == ",":
            parts.append("".join(part))
            part = []
            i += text[i + 1 : i + 2] == " "
        else:
            part.append(text[i])
        i += 1
    return [*parts, "".join(part)] if text else []


def decode(kind: Kind, text: str):
    if kind.element:
        return [decode(kind.element, p) for p in _split(text)]
    if kind is Kind.STRING:
        return text
    if kind is Kind.OBJECT:
        return base64.b64decode(text)
    if kind is Kind.LONG_DOUBLE:
        return long_double(text)
    if kind is Kind.DOUBLE:
        text = text.strip()
        if re.fullmatch(r"[+-]?0[xX].*", text):
            return float.fromhex(text)
        if not re.fullmatch(DECIMAL, text, re.I):
            raise ValueError(text)
        return float(text)
    if kind is Kind.BOOL and text in BOOLEANS:
        return BOOLEANS[text]
    if not re.fullmatch(r"[+-]?[0-9]+", text):
        raise ValueError(text)
    value, bits = int(text), 32 if kind is Kind.BOOL else kind.bits
    if not -(1 << bits - 1) <= value < 1 << bits - 1:
        raise ValueError(text)
    return value & 255 if kind is Kind.BOOL else value


def long_double(text: str) -> bytes:
    """An 80-bit extended float in 16 bytes, from decimal digits, which go by way of a double, or hexadecimal ones."""
    text = text.strip().lower()
    sign, body = (0x8000, text[1:]) if text.startswith("-") else (0, text.removeprefix("+"))
    if hexa := re.fullmatch(r"0x([0-9a-f]*)\.?([0-9a-f]*)(?:p([+-]?[0-9]+))?", body):
        whole, part, power = hexa[1], hexa[2], int(hexa[3] or 0)
        if not whole + part:
            raise ValueError(text)
        value, power = int(whole + part, 16), power - 4 * len(part)
        over = value.bit_length() - 64
        if over > 0:  # more digits than there is room for: to the nearest, halves to even
            rest, value = value & (1 << over) - 1, value >> over
            value += rest > 1 << over - 1 or rest == 1 << over - 1 and value & 1
            power += over
        return _extended(sign, value, power)
    if not re.fullmatch(DECIMAL, body, re.I) or body[:1] in "+-":
        raise ValueError(text)
    x = float(body)
    if math.isnan(x):
        return (0xC000 << 48).to_bytes(8, "little") + (sign | 0x7FFF).to_bytes(2, "little") + bytes(6)
    if math.isinf(x):
        return (1 << 63).to_bytes(8, "little") + (sign | 0x7FFF).to_bytes(2, "little") + bytes(6)
    m, e = math.frexp(x)
    return _extended(sign, int(m * (1 << 64)), e - 64)


def _extended(sign: int, value: int, power: int) -> bytes:
    """value times 2 to a power: 64 bits of which the highest is 1, and the exponent with a bias of 16383."""
    if value:
        up = 64 - value.bit_length()
        value, e = value << up, power - up + 63 + 16383
        if e >= 0x7FFF:
            value, e = 1 << 63, 0x7FFF
        elif e <= 0:  # less than the least exponent: bits fall off
            value, e = value >> min(64, 1 - e), 0
        sign |= e
    return value.to_bytes(8, "little") + sign.to_bytes(2, "little") + bytes(6)


def long_double_text(raw: bytes) -> str:
    """Hexadecimal digits that long_double reads back to the same bits."""
    value, top = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:10], "little")
    sign, e = "-" if top & 0x8000 else "", top & 0x7FFF
    if e == 0x7FFF:
        return sign + ("inf" if value == 1 << 63 else "nan")
    if not value:
        return sign + "0x0p+0"
    digits = f"{value:016x}"
    part = digits[1:].rstrip("0")
    return f"{sign}0x{digits[0]}{'.' if part else ''}{part}p{(e or 1) - 16386:+d}"


def encode(kind: Kind, value) -> str:
    if kind.element:
        return ", ".join(encode(kind.element, v).replace("\\", "\\\\").replace(",", "\\,") for v in value)
    if kind is Kind.OBJECT:
        return base64.b64encode(value).decode()
    if kind is Kind.LONG_DOUBLE:
        return long_double_text(bytes(value))
    return f"{value:.17g}" if kind is Kind.DOUBLE else str(value)


def _walk(edge: Callable[[int, int, str], None], keep: Callable[[str, int, str, Kind, str, object], None]) -> tuple[dict, dict, Callable[[bytes, bool], None]]:
    """What is known of a file so far, its vertices' numbers by name, and what takes its next bytes.

    edge gets the ends and the name of each edge, keep the domain, the number, the name, the kind, the text and the value
    of each property, those of an edge after the edge.
    """
    parser = expat.ParserCreate()
    keys: dict[str, tuple[str, str, Kind]] = {}
    defaults: dict[str, str] = {}
    ids: dict[str, int] = {}
    state = {"domain": "graph", "at": 0, "key": None, "text": None, "hint": False, "free": False, "free_edges": False, "m": 0}

    def fail(what):
        raise FormatError(f"line {parser.CurrentLineNumber}: {what}")

    def vertex(name):
        if name not in ids:
            ids[name] = len(ids)
            state["free"] |= name != f"n{ids[name]}"
            put_defaults("vertex", ids[name])
        return ids[name]

    def put(key, domain, at, text):
        name, declared, kind = keys[key]
        if declared not in (domain, "all"):
            fail(f"key {key} is for {declared}, not for {domain}")
        try:
            keep(domain, at, name, kind, text, decode(kind, text))
        except (ValueError, KeyError) as e:
            fail(f"{text!r} is no {kind.label}: {e}")

    def put_defaults(domain, at):
        for key, text in defaults.items():
            if keys[key][1] in (domain, "all"):
                put(key, domain, at, text)

    def start(tag, attributes):
        tag = tag.rsplit(":", 1)[-1]
        if tag == "key":
            kind = attributes.get("attr.type", "string")
            if kind not in TYPES:
                fail(f"unknown type {kind}")
            domain = {"node": "vertex"}.get(attributes.get("for", "all"), attributes.get("for", "all"))
            keys[attributes["id"]] = (attributes.get("attr.name", attributes["id"]), domain, TYPES[kind])
            state["key"] = attributes["id"]
        elif tag == "graph":
            state["hint"] |= attributes.get("edgedefault") == "directed"
        elif tag == "node":
            state["domain"], state["at"] = "vertex", vertex(attributes["id"])
        elif tag == "edge":
            if not {"source", "target"} <= attributes.keys():
                fail("an edge has two ends")
            state["hint"] |= attributes.get("directed") == "true"
            ends = vertex(attributes["source"]), vertex(attributes["target"])
            state["domain"], state["at"] = "edge", state["m"]
            state["m"] += 1
            name = attributes.get("id", f"e{state['at']}")
            state["free_edges"] |= name != f"e{state['at']}"
            edge(*ends, name)
            put_defaults("edge", state["at"])
        elif tag == "data":
            if attributes.get("key") not in keys:
                fail(f"unknown key {attributes.get('key')}")
            state["key"], state["text"] = attributes["key"], []
        elif tag == "default":
            state["text"] = []

    def end(tag):
        tag = tag.rsplit(":", 1)[-1]
        if tag == "data":
            put(state["key"], state["domain"], state["at"], "".join(state["text"]))
            state["text"] = None
        elif tag == "default":
            defaults[state["key"]] = "".join(state["text"])
            state["text"] = None
        elif tag in ("node", "edge"):
            state["domain"], state["at"] = "graph", 0

    def characters(text):
        if state["text"] is not None:
            state["text"].append(text)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters

    def feed(raw: bytes, last: bool) -> None:
        try:
            parser.Parse(raw, last)
        except expat.ExpatError as e:
            raise FormatError(f"line {e.lineno}: {expat.ErrorString(e.code)}") from e

    return state, ids, feed


def parse(raw: bytes) -> Document:
    """Vertices in order, edges in order; defaults count from the element on. Directed if any hint says so."""
    doc = Document(0, [], False)
    columns: dict[tuple[str, str], Column] = {}
    edge_ids: list[str] = []

    def edge(a, b, name):
        doc.edges.append((a, b))
        edge_ids.append(name)

    def keep(domain, at, name, kind, text, value):
        c = columns.setdefault((domain, name), Column(name, domain, kind, []))
        c.values += [_zero(kind) for _ in range(at + 1 - len(c.values))]
        c.values[at] = value

    state, ids, feed = _walk(edge, keep)
    feed(raw, True)
    doc.n = len(ids)
    for (domain, _), c in columns.items():
        need = {"graph": 1, "vertex": doc.n, "edge": len(doc.edges)}[domain]
        c.values += [_zero(c.kind) for _ in range(need - len(c.values))]
    doc.columns = list(columns.values())
    if state["free"]:
        doc.columns.append(Column(VERTEX_ID, "vertex", Kind.STRING, list(ids)))
    if state["free_edges"]:
        doc.columns.append(Column(EDGE_ID, "edge", Kind.STRING, edge_ids))
    doc.directed = state["hint"]
    return doc


def render(doc: Document):
    """The file in parts: keys by domain and name, vertices, then edges in order of id; empty texts are left out."""
    doc.check()
    own = doc.column(VERTEX_ID, "vertex")
    name = (lambda v: own.values[v]) if own else (lambda v: f"n{v}")
    called = doc.column(EDGE_ID, "edge")
    edge_name = (lambda i: called.values[i]) if called else (lambda i: f"e{i}")
    columns = sorted((c for c in doc.columns if c.name not in (VERTEX_ID, EDGE_ID)), key=lambda c: (("graph", "vertex", "edge").index(c.domain), c.name))
    yield b'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    for i, c in enumerate(columns):
        target = {"vertex": "node"}.get(c.domain, c.domain)
        yield f'  <key id="key{i}" for="{target}" attr.name={quoteattr(c.name)} attr.type="{NAMES[c.kind]}" />\n'.encode()

    def data(domain, at):
        for i, c in enumerate(columns):
            if c.domain == domain and (text := encode(c.kind, c.values[at])):
                yield f'<data key="key{i}">{escape(text)}</data>'

    yield f'  <graph id="G" edgedefault="{"directed" if doc.directed else "undirected"}">{"".join(data("graph", 0))}\n'.encode()
    for v in range(doc.n):
        yield f"    <node id={quoteattr(name(v))}>{''.join(data('vertex', v))}</node>\n".encode()
    for i, (a, b) in enumerate(doc.edges):
        yield f'    <edge id={quoteattr(edge_name(i))} source={quoteattr(name(a))} target={quoteattr(name(b))}>{"".join(data("edge", i))}</edge>\n'.encode()
    yield b"  </graph>\n</graphml>\n"


def write(spark: SparkSession, g: Graph, path: str) -> None:
    """The graph's file, as render has it of its document; lines are made and put in order by the executors."""
    vertices, edges, vc, ec = checked(g)
    named, called = any(c.name == VERTEX_ID for c in vc), any(c.name == EDGE_ID for c in ec)
    columns = [c for domain in (vc, ec) for c in sorted(domain, key=lambda c: c.name) if c.name not in (VERTEX_ID, EDGE_ID)]
    keys = {d: [(i, c.name, c.kind) for i, c in enumerate(columns) if c.domain == d] for d in ("vertex", "edge")}

    def data(domain, rows, at):
        return "".join(f'<data key="key{i}">{escape(text)}</data>' for i, name, kind in keys[domain] if (text := encode(kind, rows[name][at])))

    def vertex_lines(rows):
        return "".join(f"    <node id={quoteattr(rows[VERTEX_ID][i] if named else f'n{v}')}>{data('vertex', rows, i)}</node>\n" for i, v in enumerate(rows["id"])).encode()

    def edge_lines(rows):
        names = rows[EDGE_ID] if called else [f"e{i}" for i in rows["__i"]]
        return "".join(f"    <edge id={quoteattr(name)} source={quoteattr(rows['__a'][i])} target={quoteattr(rows['__b'][i])}>{data('edge', rows, i)}</edge>\n" for i, name in enumerate(names)).encode()

    edges = named_ends(vertices, edges if called else numbered(edges, ["edge_id"], "__i"), VERTEX_ID, "n")
    head = ['<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n']
    head += [f'  <key id="key{i}" for="{"node" if c.domain == "vertex" else c.domain}" attr.name={quoteattr(c.name)} attr.type="{NAMES[c.kind]}" />\n' for i, c in enumerate(columns)]
    head += [f'  <graph id="G" edgedefault="{"undirected" if g.direction == "undirected" else "directed"}">\n']
    write_parts(spark, path, ["".join(head).encode(), rendered(vertices, ["id"], vc, vertex_lines), rendered(edges, ["edge_id"], ec, edge_lines), b"  </graph>\n</graphml>\n"])


def _stream(chunks: Iterable[bytes]):
    """Rows for read_streamed; edges are given out with the piece that they begin in, but for the last, which may go on."""
    rows, props, kinds = [], {}, {}

    def edge(a, b, name):
        rows.append(("edge", state["m"] - 1, a, b, name, {}))

    def keep(domain, at, name, kind, text, value):
        kinds.setdefault((domain, name), kind)
        if domain == "edge":
            rows[-1][5][name] = text
        elif domain == "vertex":
            props.setdefault(at, {})[name] = text

    state, ids, feed = _walk(edge, keep)
    for chunk in chunks:
        feed(chunk, False)
        yield rows[:-1]
        del rows[:-1]
    feed(b"", True)
    yield rows
    yield [("vertex", i, i, None, name, props.get(i, {})) for name, i in ids.items()]
    columns = [(domain, name, kind.label, False) for (domain, name), kind in kinds.items()]
    columns += [("vertex", VERTEX_ID, Kind.STRING.label, True)] * state["free"] + [("edge", EDGE_ID, Kind.STRING.label, True)] * state["free_edges"]
    yield [("shape", None, None, None, json.dumps({"n": len(ids), "m": state["m"], "directed": state["hint"], "renumbered": False, "columns": columns}), {})]


def read(spark: SparkSession, path: str) -> Graph:
    """The graph of one file, with its properties of vertices and edges; a task of the executors holds the vertices."""
    return read_streamed(spark, path, _stream, decode)
