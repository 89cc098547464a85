"""Edge lists of delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import Kind
from .document import Column, Document, FormatError


def records(text: str, delimiter: str = ",") -> list[tuple[int, list[str]]]:
    """Line number and fields of every record that isn't blank.

    Quotes open at a field's first character only, "" stands for one, and quoted fields may hold delimiters and line
    breaks; \\n, \\r\\n and \\r end records; fields lose the white space around them after unquoting.
    """
    text = text.removeprefix("\ufeff")
    out, fields, part, quoted, fresh, line, start = [], [], [], False, True, 1, 1
    i, n = 0, len(text)

    def close_record():
        nonlocal fields, part, fresh
        fields.append("".join(part).strip())
        if fields != [""]:
            out.append((start, fields))
        fields, part, fresh = [], [], True

    while i < n:
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                part.append('"')
                i += 1
            elif c == '"':
                quoted = False
            else:
                line += c == "\n"
                part.append(c)
        elif c == '"' and fresh:
            quoted, fresh = True, False
        elif c == delimiter:
            fields.append("".join(part).strip())
            part, fresh = [], True
        elif c in "\r\n":
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
            close_record()
            line += 1
            start = line
        else:
            part.append(c)
            fresh = False
        i += 1
    if quoted:
        raise FormatError(f"line {start}: a quote is never closed")
    if part or fields:
        close_record()
    return out


def parse(raw: bytes | str, delimiter: str = ",", header: bool = False, symbolic: bool = False) -> Document:
    """Record i is edge i; fields after the second are left out. symbolic: names get ids as first seen, a source before its target."""
    text = raw.decode() if isinstance(raw, bytes) else raw
    rows = records(text, delimiter)[1 if header else 0 :]
    names: dict[str, int] = {}
    edges = []
    for line, fields in rows:
        if len(fields) < 2:
            raise FormatError(f"line {line}: an edge has two ends")
        if symbolic:
            edges.append(tuple(names.setdefault(f, len(names)) for f in fields[:2]))
        else:
            if not all(f.isascii() and f.isdigit() for f in fields[:2]):
                raise FormatError(f"line {line}: no vertex number")
            edges.append((int(fields[0]), int(fields[1])))
    n = len(names) if symbolic else max((max(e) + 1 for e in edges), default=0)
    return Document(n, edges, True, [Column("name", "vertex", Kind.STRING, list(names))] if symbolic else [])


def read_plain(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False) -> DataFrame:
    """(src, dst) of clean lists of numbers, read in parallel; without edge ids, as lines have no numbers there."""
    rows = spark.read.csv(path, sep=delimiter, header=header, schema="src long, dst long", mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.where("src IS NOT NULL AND dst IS NOT NULL")


def write(edges: DataFrame, path: str, delimiter: str = ",", header: bool = False) -> None:
    """src and dst in order of edge_id, in part files whose names are in that order. Vertices without edges are lost."""
    edges.orderBy("edge_id").select(F.col("src").alias("source"), F.col("dst").alias("target")).write.csv(path, sep=delimiter, header=header, mode="overwrite")
