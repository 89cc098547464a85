"""DOT files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import SparkSession

from ..functions.casts import Kind
from ..graph import Graph
from .document import Column, Document, FormatError, checked, named_ends, read_streamed, rendered, write_parts

VERTEX_NAME = "vertex_name"
_SPACE = re.compile(r'(?:\s+|//[^\n]*|/\*.*?\*/|^\#[^\n]*)+', re.S | re.M)
_TOKEN = re.compile(r'(?P<arrow>->|--)|(?P<id>[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*|-?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?))|(?P<quoted>"(?:\\.|[^"\\])*")|(?P<mark>[{}\[\];,=:+])', re.S)
_PLAIN = re.compile(r"([A-Za-z_][A-Za-z0-9_]*|-?(\.[0-9]+|[0-9]+(\.[0-9]*)?))\Z")
_WORDS = {"strict", "graph", "digraph", "node", "edge", "subgraph"}


def tokens(text: str) -> list[tuple[str, str, int]]:
    """Kind, text and line of every token; quoted texts are joined at +, HTML texts keep their brackets."""
    return list(_joined(_lexed([text])))


def _joined(found: Iterable[tuple[str, str, int]]) -> Iterator[tuple[str, str, int]]:
    """The tokens with texts joined at +; quoted ones become texts."""
    held = []  # a text, and maybe a + after it
    for kind, value, line in found:
        if kind == "quoted" and len(held) == 2:
            held = [("text", held[0][1] + value, held[0][2])]
        elif (kind, value) == ("mark", "+") and len(held) == 1:
            held.append((kind, value, line))
        else:
            yield from held
            held = []
            if kind == "quoted":
                held = [("text", value, line)]
            else:
                yield kind, value, line
    yield from held


def _lexed(chunks: Iterable[str]) -> Iterator[tuple[str, str, int]]:
    """The tokens of a text in pieces, of which no more is held than a token needs and the character before it."""
    chunks = iter(chunks)
    text, at, line, counted = next(chunks, ""), 0, 1, 0

    def more() -> bool:
        nonlocal text, at, line, counted
        if (new := next(chunks, None)) is None:
            return False
        line += text.count("\n", counted, at)
        keep = max(0, at - 1)
        text, at = text[keep:] + new, at - keep
        counted = at
        return True

    while True:
        if (m := _SPACE.match(text, at)) and (m.end() < len(text) or not more()):
            at = m.end()
        elif m:
            continue
        if at >= len(text):
            if more():
                continue
            return
        line, counted = line + text.count("\n", counted, at), at
        if text[at] == "<":
            depth, end = 0, at
            while end < len(text):
                depth += {"<": 1, ">": -1}.get(text[end], 0)
                end += 1
                if depth == 0:
                    break
            else:
                if more():
                    continue
                raise FormatError(f"line {line}: an HTML text is never closed")
            yield "id", text[at:end], line
            at = end
            continue
        m = _TOKEN.match(text, at)
        if (not m and text[at] in '"/-.' or m and m.end() == len(text)) and more():
            continue
        if not m:
            raise FormatError(f"line {line}: {text[at]!r} is unexpected")
        at = m.end()
        if m.lastgroup == "quoted":
            yield "quoted", m[0][1:-1].replace("\\\n", "").replace('\\"', '"'), line
        elif m.lastgroup == "id" and m[0].lower() in _WORDS:
            yield "word", m[0].lower(), line
        else:
            yield m.lastgroup, m[0], line


class _Parser:
    def __init__(self, chunks: Iterable[str]):
        self.rest, self.all, self.at = _joined(_lexed(chunks)), [], 0
        self.ahead()
        self.vertices: dict[str, dict[str, str]] = {}
        self.edges: list[tuple[str, str, dict[str, str]]] = []
        self.graph: dict[str, str] = {}
        self.seen: set = set()
        self.strict = self.directed = False

    def ahead(self) -> None:
        """Sees to it that the next two tokens are there, and the last, where there are such."""
        if self.at + 2 > len(self.all):
            self.all = [*self.all[max(0, self.at - 1) :], *islice(self.rest, 1000)]
            self.at = min(self.at, 1)

    def peek(self, kind: str, value: str | None = None) -> bool:
        return self.at < len(self.all) and self.all[self.at][0] == kind and value in (None, self.all[self.at][1])

    def take(self, kind: str, value: str | None = None) -> str:
        if not self.peek(kind, value):
            where = f"line {self.all[self.at][2]}: {self.all[self.at][1]!r}" if self.at < len(self.all) else "at the end: nothing"
            raise FormatError(f"{where} where {value or kind} was due")
        self.at += 1
        self.ahead()
        return self.all[self.at - 1][1]

    def maybe(self, kind: str, value: str) -> bool:
        found = self.peek(kind, value)
        self.at += found
        self.ahead()
        return found

    def name(self) -> str:
        return self.take("text") if self.peek("text") else self.take("id")

    def whole(self) -> Iterator[None]:
        """Goes over the file, and stops after each statement of its block."""
        self.strict = self.maybe("word", "strict")
        self.directed = self.maybe("word", "digraph")
        if not self.directed:
            self.take("word", "graph")
        if not self.peek("mark", "{"):
            self.name()
        for _ in self.statements({}, {}, True):
            yield
        if self.at < len(self.all):
            raise FormatError(f"line {self.all[self.at][2]}: more follows the graph")

    def block(self, node: dict, edge: dict, top: bool) -> dict[str, None]:
        """The vertices of a block in braces; node and edge are the attributes that hold in it by default."""
        return {v: None for found in self.statements(node, edge, top) for v in found}

    def statements(self, node: dict, edge: dict, top: bool) -> Iterator[dict[str, None]]:
        """As block, the vertices of a statement at a time."""
        self.take("mark", "{")
        node, edge = dict(node), dict(edge)
        while not self.maybe("mark", "}"):
            if self.peek("word") and self.all[self.at][1] in ("graph", "node", "edge"):
                word = self.take("word")
                {"graph": self.graph if top else {}, "node": node, "edge": edge}[word].update(self.attributes())
            elif self.peek("id") or self.peek("text") or self.peek("mark", "{") or self.peek("word", "subgraph"):
                if not self.peek("mark") and self.at + 1 < len(self.all) and self.all[self.at + 1][:2] == ("mark", "="):
                    key = self.name()
                    self.take("mark", "=")
                    value = self.name()
                    if top:
                        self.graph[key] = value
                else:
                    yield self.statement(node, edge)
            elif not (self.maybe("mark", ";") or self.maybe("mark", ",")):
                self.take("mark", "}")

    def statement(self, node: dict, edge: dict) -> dict[str, None]:
        sides = [self.side(node, edge)]
        while self.peek("arrow"):
            if (self.take("arrow") == "->") != self.directed:
                raise FormatError(f"line {self.all[self.at - 1][2]}: the other kind of edge")
            sides.append(self.side(node, edge))
        own = self.attributes()
        if len(sides) == 1:
            for v in sides[0]:
                self.vertices[v].update(own)
        for a, b in zip(sides, sides[1:], strict=False):
            for s in a:
                for t in b:
                    if self.strict:
                        key = (s, t) if self.directed else (min(s, t), max(s, t))
                        if s == t or key in self.seen:
                            continue
                        self.seen.add(key)
                    self.edges.append((s, t, {**edge, **own}))
        return dict.fromkeys(v for s in sides for v in s)

    def side(self, node: dict, edge: dict) -> list[str]:
        if self.maybe("word", "subgraph"):
            if not self.peek("mark", "{"):
                self.name()
            return list(self.block(node, edge, False))
        if self.peek("mark", "{"):
            return list(self.block(node, edge, False))
        v = self.name()
        while self.maybe("mark", ":"):
            self.name()
        self.vertices.setdefault(v, dict(node))
        return [v]

    def attributes(self) -> dict[str, str]:
        out = {}
        while self.maybe("mark", "["):
            while not self.maybe("mark", "]"):
                key = self.name()
                out[key] = self.name() if self.maybe("mark", "=") else "true"
                if not self.maybe("mark", ","):
                    self.maybe("mark", ";")
        return out


def parse(raw: bytes) -> Document:
    """Vertices in order of their names, edges in order; all attributes are texts, empty where unset."""
    p = _Parser([raw.decode()])
    for _ in p.whole():
        pass
    names = sorted(p.vertices)
    ids = {v: i for i, v in enumerate(names)}
    columns = [Column(VERTEX_NAME, "vertex", Kind.STRING, names)]
    columns += [Column(k, "graph", Kind.STRING, [v]) for k, v in p.graph.items()]
    columns += [Column(k, "vertex", Kind.STRING, [p.vertices[v].get(k, "") for v in names]) for k in dict.fromkeys(k for v in names for k in p.vertices[v])]
    columns += [Column(k, "edge", Kind.STRING, [e[2].get(k, "") for e in p.edges]) for k in dict.fromkeys(k for e in p.edges for k in e[2])]
    return Document(len(names), [(ids[a], ids[b]) for a, b, _ in p.edges], p.directed, columns)


def _quoted(text: str) -> str:
    return text if _PLAIN.match(text) and text.lower() not in _WORDS else '"' + text.replace('"', '\\"') + '"'


def render(doc: Document):
    """The file in parts: vertices, then edges; attributes by name, those of the graph are left out."""
    doc.check()
    own = doc.column(VERTEX_NAME, "vertex")
    name = (lambda v: _quoted(own.values[v])) if own else str
    arrow = "->" if doc.directed else "--"

    def attributes(domain, at):
        found = sorted((c.name, c.values[at]) for c in doc.columns if c.domain == domain and c.name != VERTEX_NAME)
        return " [" + ", ".join(f"{_quoted(k)}={_quoted(str(v))}" for k, v in found) + "]" if found else ""

    yield f"{'digraph' if doc.directed else 'graph'} G {{\n".encode()
    for v in range(doc.n):
        yield f"  {name(v)}{attributes('vertex', v)};\n".encode()
    for i, (a, b) in enumerate(doc.edges):
        yield f"  {name(a)} {arrow} {name(b)}{attributes('edge', i)};\n".encode()
    yield b"}\n"


def _attributes(found: list[tuple[str, object]]) -> str:
    return " [" + ", ".join(f"{_quoted(k)}={_quoted(str(v))}" for k, v in sorted(found)) + "]" if found else ""


def write(spark: SparkSession, g: Graph, path: str) -> None:
    """The graph's file, as render has it of its document; lines are made and put in order by the executors."""
    vertices, edges, vc, ec = checked(g)
    own = any(c.name == VERTEX_NAME for c in vc)
    directed, called = g.direction != "undirected", _quoted if own else str
    arrow, vn, en = "->" if directed else "--", [c.name for c in vc if c.name != VERTEX_NAME], [c.name for c in ec if c.name != VERTEX_NAME]

    def vertex_lines(rows):
        names = rows[VERTEX_NAME] if own else rows["id"]
        return "".join(f"  {called(v)}{_attributes([(k, rows[k][i]) for k in vn])};\n" for i, v in enumerate(names)).encode()

    def edge_lines(rows):
        return "".join(f"  {called(a)} {arrow} {called(b)}{_attributes([(k, rows[k][i]) for k in en])};\n" for i, (a, b) in enumerate(zip(rows["__a"], rows["__b"], strict=True))).encode()

    edges = named_ends(vertices, edges, VERTEX_NAME, "")
    write_parts(spark, path, [f"{'digraph' if directed else 'graph'} G {{\n".encode(), rendered(vertices, ["id"], vc, vertex_lines), rendered(edges, ["edge_id", "src", "dst"], ec, edge_lines), b"}\n"])


def _stream(chunks: Iterable[bytes], size: int = 20_000):
    """Rows for read_streamed. Vertices are numbered as they come, and get their number by name at the end."""
    p, keys, m, index = _Parser(c.decode() for c in chunks), {}, 0, {}

    def rows():
        nonlocal m
        for a, b, props in p.edges:
            keys.update(dict.fromkeys(props))
            yield "edge", m, index.setdefault(a, len(index)), index.setdefault(b, len(index)), None, props
            m += 1
        p.edges.clear()

    for _ in p.whole():
        if len(p.edges) >= size:
            yield list(rows())
    yield list(rows())
    names = sorted(p.vertices)
    yield [("vertex", index.setdefault(v, len(index)), i, None, v, p.vertices[v]) for i, v in enumerate(names)]
    text = Kind.STRING.label
    columns = [("vertex", VERTEX_NAME, text, True)] + [("vertex", k, text, False) for k in dict.fromkeys(k for v in names for k in p.vertices[v])] + [("edge", k, text, False) for k in keys]
    yield [("shape", None, None, None, json.dumps({"n": len(names), "m": m, "directed": p.directed, "renumbered": True, "columns": columns}), {})]


def read(spark: SparkSession, path: str) -> Graph:
    """The graph of one file, with its properties; a task of the executors holds the vertices, and of strict graphs the pairs of ends."""
    return read_streamed(spark, path, _stream, lambda kind, text: text)
