"""The SQL of text operators against the operators, on rows with nulls, empty and long texts and repeats."""

from collections import Counter

import duckdb
import pytest
from test_documents import SCHEMA, make_docs

from sparkweave.llm import decontaminate, minhash, suffix_dedup

BENCHMARK = [(1, "the quick brown fox jumps over the lazy dog again"), (2, "Seven, short words"), (3, None), (None, "changed"), (4, ""), (5, "ab ñe c " * 9), (5, "ab ñe c " * 9), (6, "lone")]


@pytest.fixture(scope="module")
def rows():
    found = make_docs(11, 40)
    said = "x the quick BROWN fox jumps under the lazy dog, again y"
    return [*found, (200, said, "en", "s", len(said), "", "", ""), (201, "seven short words " + "ab ñe c " * 5 + "Lone", "en", "s", 1, "", "", ""), (202, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def con(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", BENCHMARK)
    return con


@pytest.mark.parametrize("name", ["near", "suffix", "benchmark"])
def test_sql_agrees(spark, rows, con, name):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if name == "near":
        out, sql = minhash.near_duplicates(docs, minhash.Similarity(3, 85)), minhash.SQL
    elif name == "suffix":
        out, sql = suffix_dedup.query(docs), suffix_dedup.SQL
    else:
        out, sql = decontaminate.query(docs, spark.createDataFrame(BENCHMARK, "item_id long, text string")), decontaminate.SQL
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(out.columns)
    want = Counter(found.fetchall())
    assert Counter(tuple(r) for r in out.select(*names).collect()) == want
    for empty in ("documents", "benchmark"):
        assert con.execute(f"WITH {empty} AS (SELECT * FROM memory.main.{empty} WHERE false) SELECT count(*) FROM ({sql})").fetchone()[0] == (0 if empty == "documents" else len(rows))
