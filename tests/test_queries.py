"""Registered graph queries over whole small tables, against plain Python."""

import datetime
import math
import random
from collections import Counter

import pytest

from sparkweave.queries import QUERIES

USERS = 9


def events(spark, tmp_path, users):
    """A folder with an events table of these users, one after the other."""
    start = datetime.datetime(2026, 1, 1)
    rows = [(i, u, start + datetime.timedelta(minutes=i), float(i % 5 + 1)) for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path), list(zip(users, users[1:]))


@pytest.fixture
def walk(spark, tmp_path):
    rng = random.Random(5)
    return events(spark, tmp_path, [*rng.sample(range(USERS), USERS), *(rng.randrange(USERS) for _ in range(25)), USERS])


def brute_betweenness(n, arcs):
    """Shares of shortest paths through vertices and edges; arcs are (from, to, edge), parallel ones different paths."""
    vertex, edge = Counter(), Counter()
    for s in range(n):
        paths, seen = {s: [((s,), ())]}, {s}
        while paths:
            nxt = {}
            for v, ways in paths.items():
                for a, b, k in arcs:
                    if a == v and b not in seen:
                        nxt.setdefault(b, []).extend((p + (b,), e + (k,)) for p, e in ways)
            for ways in nxt.values():
                for p, e in ways:
                    for x in p[1:-1]:
                        vertex[x] += 1 / len(ways)
                    for k in e:
                        edge[k] += 1 / len(ways)
            seen |= set(nxt)
            paths = nxt
    return vertex, edge


def test_betweenness_is_of_every_edge(spark, walk):
    folder, edges = walk
    arcs = [(a, b, k) for k, (a, b) in enumerate(edges)]
    found = {r.id: r.betweenness for r in QUERIES["betweenness"](spark, folder).collect()}
    vertex, _ = brute_betweenness(USERS + 1, arcs)
    assert found == pytest.approx({i: vertex[i] for i in range(USERS + 1)}, abs=1e-6)
    found = {r.edge_id: r.betweenness for r in QUERIES["betweenness_edges"](spark, folder).collect()}
    _, edge = brute_betweenness(USERS + 1, arcs + [(b, a, k) for a, b, k in arcs])
    assert found == pytest.approx({k: edge[k] / 2 for k in range(len(edges))}, abs=1e-6)


def test_components_are_of_every_edge(spark, walk):
    folder, edges = walk
    reach = [{i} for i in range(USERS + 1)]
    for _ in reach:
        for a, b in edges:
            for r in reach:
                if a in r:
                    r.add(b)
    strong = {i: min(j for j in reach[i] if i in reach[j]) for i in range(USERS + 1)}
    assert {r.id: r.root for r in QUERIES["strong_components"](spark, folder).collect()} == strong
    root = {i: min(j for j in range(USERS + 1) if i in reach[j]) for i in range(USERS + 1)}
    best = min(Counter(root.values()).items(), key=lambda x: (-x[1], x[0]))[0]
    assert {r.id: r.inside for r in QUERIES["largest_component"](spark, folder).collect()} == {i: int(root[i] == best) for i in root}


def test_is_dag_takes_every_edge(spark, walk, monkeypatch):
    """The acyclic case is all of later(user_seq): its edges are counted where the operator gets them."""
    from sparkweave import queries

    folder, edges = walk
    counts = []
    monkeypatch.setattr(queries.D, "geo", lambda spark, sf_dir: queries.D.later(queries.D.user_seq(spark, sf_dir)))
    monkeypatch.setattr(queries.T, "is_dag", lambda g: counts.append(g.num_edges()) or True)
    QUERIES["is_dag"](spark, folder)
    assert counts == [sum(a < b for a, b in edges)] * 2 + [len(edges)]


@pytest.mark.parametrize("undirected", [False, True])
def test_moves_of_every_vertex_are_priced(spark, walk, undirected):
    """By two entropies in plain Python each."""
    folder, edges = walk

    def entropy(b):
        pairs = Counter(tuple(sorted((b[x], b[y]))) if undirected else (b[x], b[y]) for x, y in edges)
        out, into = Counter(b[x] for x, _ in edges), Counter(b[y] for _, y in edges)
        ends = [out + into] if undirected else [out, into]
        loops = sum(k * math.log(2) for (r, s), k in pairs.items() if r == s) if undirected else 0
        return sum(math.lgamma(k + 1) for c in ends for k in c.values()) - sum(math.lgamma(k + 1) for k in pairs.values()) - loops

    b = {i: i % 8 for i in range(USERS + 1)}
    found = {r.move_id: r.ds for r in QUERIES["sbm_move_prices_undirected" if undirected else "sbm_move_prices"](spark, folder).collect()}
    assert found == pytest.approx({i: entropy(b | {i: (i + 3) % 8}) - entropy(b) for i in b}, abs=2e-5)


@pytest.mark.parametrize("name", ["binary", "graphml", "dot"])
def test_whole_graphs_are_written_and_read(spark, walk, name):
    """Vertices are 0 to 9, so that DOT's order by name is that of the ids."""
    folder, edges = walk
    found = QUERIES[f"{name}_round_trip"](spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted((a, b, float(k % 5 + 1)) for k, (a, b) in enumerate(edges))


def test_dot_takes_time_in_proportion():
    from sparkweave.sources import dot

    class Text(str):
        scanned = 0

        def count(self, sub, start=0, end=None):
            Text.scanned += end - start
            return super().count(sub, start, end)

    text = Text("digraph G {\n" + "".join(f"  {i} -> {i + 1};\n" for i in range(500)) + "}\n")
    assert dot.tokens(text)[-1] == ("mark", "}", 502) and Text.scanned <= len(text)
