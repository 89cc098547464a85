"""Views, mutation and operators on small graphs whose answers are known, and against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkweave.graph import Graph, GraphError, NotDirectedError
from sparkweave.operators import blockmodel, centrality, components, degree, topology, traversal

INF = float("inf")
FAR = traversal.UNREACHABLE
TRAVEL = [(0, 1), (1, 2), (2, 0), (1, 3), (3, 4), (5, 4), (2, 4)]
MIXED = [(0, 1), (1, 2), (2, 1), (2, 3), (4, 2), (3, 3)]


def graph(spark, n, edges, weights=None):
    rows = [(i, a, b, float(weights[i] if weights else 1)) for i, (a, b) in enumerate(edges)]
    return Graph(spark.range(n).select("id"), spark.createDataFrame(rows, "edge_id long, src long, dst long, weight double"), n, len(edges))


def column(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_hop_distances_on_six_views(spark):
    g = graph(spark, 6, TRAVEL)
    f = g.filtered(F.col("id") != 3, F.col("edge_id") != 6)
    d = lambda view, s: column(traversal.shortest_distances(view, s), "distance")
    assert d(g, 0) == [0, 1, 2, 2, 3, FAR]
    assert d(g.reversed(), 0) == [0, 2, 1, FAR, FAR, FAR]
    assert d(g.undirected(), 0) == [0, 1, 1, 2, 2, 3]
    assert d(f, 0) == [0, 1, 2, FAR, FAR, FAR]
    assert d(f.reversed(), 0) == [0, 2, 1, FAR, FAR, FAR]
    assert d(f.undirected(), 0) == [0, 1, 1, FAR, FAR, FAR]
    assert d(g, 5) == [FAR, FAR, FAR, FAR, 1, 0]
    assert f.num_vertices() == 5 and f.vertex_bound == 6
    with pytest.raises(GraphError):
        traversal.bfs(g, [17])


def test_shortest_paths(spark):
    g = graph(spark, 6, MIXED)
    assert column(traversal.dijkstra(g, 0, "weight"), "distance") == [0, 1, 2, 3, INF, INF]
    assert column(traversal.dijkstra(g.undirected(), 0), "distance") == [0, 1, 2, 3, 3, INF]
    assert column(traversal.dijkstra(g.reversed(), 3, "weight"), "distance") == [3, 2, 1, 0, 2, INF]
    with pytest.raises(ValueError, match="negative"):
        traversal.dijkstra(graph(spark, 2, [(0, 1)], [-1]), 0, "weight")


def test_best_paths_have_any_number_of_edges(spark):
    g = graph(spark, 21, [(i, i + 1) for i in range(20)] + [(0, 20)], [1] * 20 + [50])
    assert column(traversal.dijkstra(g, 0, "weight"), "distance") == list(range(21))


def test_depth_first():
    order = {0: [1, 2], 1: [3], 2: [3], 3: []}
    assert traversal.dfs(order, 0) == [(0, 0), (1, 1), (3, 2), (2, 1)]
    done = []
    traversal.dfs(order, 0, lambda v, d: "prune" if v == 1 else None, lambda v, d: done.append(v))
    assert done == [3, 2, 0]


def test_components(spark):
    g = graph(spark, 6, MIXED)
    assert column(components.labels(components.components(g)), "label") == [0, 0, 0, 0, 1, 2]
    assert column(components.labels(components.components(g.undirected())), "label") == [0, 0, 0, 0, 0, 1]
    assert column(components.strong_components(g), "root") == [0, 1, 1, 3, 4, 5]
    assert column(components.largest_component(g), "inside") == [1, 1, 1, 1, 0, 0]
    with pytest.raises(NotDirectedError):
        components.strong_components(g.undirected())


def test_random_components(spark):
    rng = random.Random(3)
    for n, m in ((9, 8), (14, 20)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        reach = [{i} for i in range(n)]
        for _ in range(n):
            for a, b in edges:
                for i in range(n):
                    if a in reach[i]:
                        reach[i].add(b)
        g = graph(spark, n, edges)
        assert column(components.components(g), "root") == [min(i for i in range(n) if v in reach[i]) for v in range(n)]
        assert column(components.strong_components(g), "root") == [min(i for i in range(n) if v in reach[i] and i in reach[v]) for v in range(n)]


def test_a_long_path_needs_few_rounds(spark):
    n = 200
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    g = graph(spark, n, list(zip(ids, ids[1:]))).undirected()
    assert set(column(components.components(g), "root")) == {0}


def test_degrees(spark):
    edges = [(0, 1)] * 2 + [(0, 2)] * 2 + [(0, 3)] * 2 + [(0, 4)] * 2 + [(0, 5), (0, 0), (1, 2), (2, 0)]
    g = graph(spark, 6, edges, range(1, 13))
    rows = degree.degrees(g, "weight").orderBy("id").collect()
    assert rows[0].degree == 12 and rows[0].out_degree == 10 and rows[0].weighted_degree == sum(range(1, 11)) + 10 + 12
    h = {r.degree: r["count"] for r in degree.degree_histogram(g).collect()}
    assert len(h) == 13 and sum(h.values()) == 6 and sum(k * v for k, v in h.items()) == 24
    assert degree.degrees(g, 2.0).orderBy("id").first().weighted_degree == 24
    assert degree.degree_histogram(Graph.empty(spark)).count() == 0
    assert degree.det_sum(g.edges, "weight", "edge_id", 3).first()[0] == 78


def test_mutation(spark):
    g = graph(spark, 4, [(0, 1), (1, 2), (2, 0), (0, 0), (0, 1)])
    ends = lambda x: sorted((r.edge_id, r.src, r.dst) for r in x.edges.collect())
    cut = g.remove_edges([1, 3])
    more = cut.add_edges(spark.createDataFrame([(0, 3), (1, 3), (2, 3)], "src long, dst long"))
    assert ends(more) == [(0, 0, 1), (1, 1, 3), (2, 2, 0), (3, 0, 3), (4, 0, 1), (5, 2, 3)] and more.edge_bound == 6 and more.n_released == 0
    assert ends(cut.compact_edges()) == [(0, 0, 1), (1, 2, 0), (2, 0, 1)]
    assert ends(g.clear_vertices([0])) == [(1, 1, 2)]
    gone = g.add_vertices().add_edges(spark.createDataFrame([(4, 2)], "src long, dst long")).swap_remove_vertex(1)
    assert ends(gone) == [(2, 2, 0), (3, 0, 0), (5, 1, 2)] and gone.vertex_bound == 4
    g.validate()
    with pytest.raises(GraphError):
        g.remove_edges([9])
    with pytest.raises(GraphError):
        g.add_edges(spark.createDataFrame([(0, 9)], "src long, dst long"))


def test_views(spark):
    g = graph(spark, 4, [(0, 1), (1, 2), (2, 0), (0, 0), (0, 1)])
    assert g.reversed().reversed().edges.collect() == g.edges.collect() and g.reversed().undirected().direction == "undirected"
    assert g.incidence().where("v = 0").count() == 5 + 0 and g.undirected().out().where("v = 0 AND other = 0").count() == 2
    with pytest.raises(NotDirectedError):
        g.undirected().reversed()


def test_topology(spark):
    dag = graph(spark, 5, [(0, 1), (0, 2), (1, 3), (2, 3)])
    assert topology.is_dag(dag) and not topology.is_dag(graph(spark, 2, [(0, 1), (1, 1)])) and not topology.is_dag(dag.undirected())
    level = {r.id: r.level for r in topology.topological_sort(dag).collect()}
    assert level == {0: 0, 1: 1, 2: 1, 3: 2, 4: 0}
    assert topology.topological_sort(graph(spark, 2, [(0, 1), (1, 0)])) is None
    assert column(topology.bipartition(graph(spark, 4, [(0, 1), (1, 2), (2, 3), (3, 0)])), "colour") == [1, 0, 1, 0]
    assert topology.bipartition(graph(spark, 3, [(0, 1), (1, 2), (2, 0)])) is None
    assert topology.bipartition(graph(spark, 2, [(0, 1), (1, 1)])) is None


@pytest.mark.parametrize("n", [3, 5])
def test_complete_graphs(spark, n):
    g = graph(spark, n, [(a, b) for a in range(n) for b in range(a + 1, n)])
    assert topology.count_triangles(g).first()[0] == math.comb(n, 3)
    assert topology.global_clustering(g).first()[0] == 1


def test_reciprocity_and_clustering_without_pairs(spark):
    r = lambda n, e: topology.reciprocity(graph(spark, n, e)).first()[0]
    assert r(2, [(0, 1)]) == 0 and r(2, [(0, 1), (1, 0)]) == 1
    assert r(2, [(0, 1), (0, 1), (1, 0)]) == pytest.approx(2 / 3) and math.isnan(r(2, [(0, 0)]))
    assert math.isnan(topology.global_clustering(graph(spark, 2, [(0, 1)])).first()[0])


@pytest.mark.parametrize(("n", "edges", "core"), [(4, [(0, 1), (1, 2), (2, 0), (0, 3)], [2, 2, 2, 1]), (2, [(0, 1), (0, 0)], [2, 1]), (2, [(0, 1)] * 3, [3, 3]), (3, [(0, 1), (1, 0), (1, 2)], [2, 2, 1])])
def test_cores(spark, n, edges, core):
    assert column(topology.core_numbers(graph(spark, n, edges)), "core") == core


def test_centrality(spark):
    one, sweeps = centrality.pagerank(graph(spark, 2, [(0, 1)]), epsilon=0, max_iter=1)
    assert column(one, "rank") == pytest.approx([0.2875, 0.7125]) and sweeps == 1
    many, _ = centrality.pagerank(graph(spark, 6, MIXED), epsilon=0, max_iter=20)
    assert column(many, "rank") == pytest.approx([0.029126214, 0.120220087, 0.156077193, 0.636324078, 0.029126214, 0.029126214], abs=1e-9)
    zero, _ = centrality.pagerank(graph(spark, 3, [(0, 1), (1, 2)], [0, 1]), epsilon=0, max_iter=5, weight="weight")
    alone, _ = centrality.pagerank(graph(spark, 3, [(1, 2)]), epsilon=0, max_iter=5)
    assert column(zero, "rank") == pytest.approx(column(alone, "rank"))
    x, norm, _ = centrality.eigenvector(graph(spark, 3, [(0, 1), (1, 2), (2, 0)]), max_iter=5)
    assert column(x, "x") == pytest.approx([3**-0.5] * 3) and norm == pytest.approx(1)


def test_betweenness_of_a_path(spark):
    g = graph(spark, 9, [(i, i + 1) for i in range(8)])
    for view in (g, g.undirected()):
        vertex, edge = centrality.betweenness(view)
        assert column(vertex, "betweenness") == pytest.approx([i * (8 - i) for i in range(9)])
        assert column(edge, "betweenness", "edge_id") == pytest.approx([(i + 1) * (8 - i) for i in range(8)])


def test_betweenness_writes_no_row_for_a_pivot_and_a_vertex(spark, monkeypatch):
    written, fixed = [], centrality.Loop.fixed

    def counted(loop, df, name):
        written.append((out := fixed(loop, df, name)).count())
        return out

    monkeypatch.setattr(centrality.Loop, "fixed", counted)
    n, tasks = 30, spark.sparkContext.defaultParallelism
    vertex, _ = centrality.betweenness(graph(spark, n, [(i, i + 1) for i in range(n - 1)]))
    assert column(vertex, "betweenness") == pytest.approx([i * (n - 1 - i) for i in range(n)])
    assert len(written) == 2 and sum(written) <= n + 2 * n * tasks


@pytest.mark.parametrize("arcs", [1, 7])
def test_betweenness_in_small_pieces(monkeypatch, arcs):
    import numpy as np

    monkeypatch.setattr(centrality, "ARCS", arcs)
    ends = np.array([(i, j) for i in range(6) for j in range(6) if i != j and (i + j) % 4])
    ids, through, flow = centrality._dependencies(*ends.T, np.ones(len(ends), int), np.arange(6))
    monkeypatch.setattr(centrality, "ARCS", 1 << 21)
    whole = centrality._dependencies(*ends.T, np.ones(len(ends), int), np.arange(6))
    assert list(ids) == list(range(6)) and through == pytest.approx(whole[1]) and flow == pytest.approx(whole[2])


def test_betweenness_writes_a_sum_once(spark, monkeypatch):
    """Not for each task that has pivots: 29 edges, and of 30 vertices and 29 arcs one sum each."""
    written, fixed = [], centrality.Loop.fixed

    def counted(loop, df, name):
        written.append((out := fixed(loop, df, name)).count())
        return out

    monkeypatch.setattr(centrality.Loop, "fixed", counted)
    n = 30
    _, edge = centrality.betweenness(graph(spark, n, [(i, i + 1) for i in range(n - 1)]).undirected())
    assert column(edge, "betweenness", "edge_id") == pytest.approx([(i + 1) * (n - 1 - i) for i in range(n - 1)])
    assert sum(written) <= 2 * (n - 1) + n


@pytest.mark.parametrize("both", [False, True])
def test_betweenness_of_more_paths_than_a_number_holds(both):
    """40 edges side by side, 300 times over with two ways each: 80 ** 300 paths; as for single edges."""
    import numpy as np

    ends = np.array([(2 * i + a, 2 * i + 2 + b) for i in range(300) for a in (0, 1) for b in (0, 1)])
    ends = np.concatenate([ends, ends[:, ::-1]]) if both else ends
    one, many = (centrality._dependencies(*ends.T, np.full(len(ends), k), np.arange(602)) for k in (1, 40))
    assert many[1] == pytest.approx(one[1]) and many[2] * 40 == pytest.approx(one[2])


def test_betweenness_goes_once_from_where_ways_lead(monkeypatch):
    """Pivots with one way out share the column of the vertex that they come to: 5 ways of 20 vertices that meet in 2 with a choice."""
    import numpy as np

    starts, alike = [], centrality._alike

    def counted(begin, degree, target, pivots):
        starts.extend(pivots)
        return alike(begin, degree, target, pivots)

    monkeypatch.setattr(centrality, "_alike", counted)
    ways = [[*range(2 + 20 * k, 22 + 20 * k), k % 2] for k in range(5)]
    arcs = [x for way in ways for x in zip(way, way[1:])] + [(0, 2), (0, 22), (0, 1), (1, 42), (1, 62), (1, 82)]
    _, through, flow = centrality._dependencies(*np.array(arcs).T, np.ones(len(arcs), int), np.arange(102))
    vertex, edge = Counter(), Counter()
    after = {v: [(b, k) for k, (a, b) in enumerate(arcs) if a == v] for v in range(102)}
    for s in range(102):
        paths, seen = [(s, (), ())], {s}
        while paths:
            found = {}
            for v, p, e in paths:
                for b, k in after[v]:
                    if b not in seen:
                        found.setdefault(b, []).append((b, p + (b,), e + (k,)))
            for rows in found.values():
                for _, p, e in rows:
                    vertex.update({x: 1 / len(rows) for x in p[:-1]})
                    edge.update({k: 1 / len(rows) for k in e})
            seen |= set(found)
            paths = [row for rows in found.values() for row in rows]
    assert through == pytest.approx([vertex[i] for i in range(102)]) and flow == pytest.approx([edge[k] for k in range(len(arcs))])
    assert sorted(starts) == [0, 1]


@pytest.mark.parametrize("length", [11, 12])
def test_betweenness_goes_once_for_a_chain_from_its_end(monkeypatch, length):
    """Chains between 6 vertices that are neighbours of all: most of a chain's pivots share the columns of its ends; as from each alone, also in shares."""
    import numpy as np

    starts, alike = [], centrality._alike

    def counted(begin, degree, target, pivots):
        starts.append(len(pivots))
        return alike(begin, degree, target, pivots)

    monkeypatch.setattr(centrality, "_alike", counted)
    ends, n = [(i, j) for i in range(6) for j in range(i)], 6
    for a in range(6):
        chain = [a, *range(n, n + length - 1), (a + 1) % 6]
        ends, n = ends + list(zip(chain, chain[1:])), n + length - 1
    v, other = np.array(ends).T
    m = np.arange(len(v)) % 3 + 1
    arcs = np.concatenate([v, other]), np.concatenate([other, v]), np.concatenate([m, m])
    alone = [centrality._dependencies(*arcs, np.array([k])) for k in range(n)]
    starts.clear()
    whole = centrality._dependencies(*arcs, np.arange(n))
    assert sum(starts) <= 6 + 6 * 2
    shares = [centrality._dependencies(*arcs, np.arange(n), (k, 4)) for k in range(4)]
    for which in (1, 2):
        assert whole[which] == pytest.approx(sum(x[which] for x in alone)) and sum(x[which] for x in shares) == pytest.approx(whole[which])


def test_betweenness_of_loops_parallel_edges_and_lone_vertices(spark):
    g = graph(spark, 6, [(0, 1), (1, 0), (1, 1), (1, 2), (2, 3), (0, 3), (3, 2)])
    vertex, edge = centrality.betweenness(g.undirected())
    assert column(vertex, "betweenness") == pytest.approx([0.5, 0.5, 0.5, 0.5, 0, 0])
    assert column(edge, "betweenness", "edge_id") == pytest.approx([1, 1, 0, 2, 1, 2, 1])
    vertex, edge = centrality.betweenness(graph(spark, 3, []).undirected())
    assert column(vertex, "betweenness") == [0, 0, 0] and edge.count() == 0


@pytest.mark.parametrize("both", [False, True])
def test_betweenness_in_chunks_of_tasks(monkeypatch, both):
    """Tasks with some of the pivots, one with none, add up to all; ids of any size."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(centrality, "CHUNK", 4)
    name = np.array([-(1 << 63), -5, 0, 3, 1 << 60, (1 << 63) - 1])
    v, other = name[np.array([(i, j) for i in range(6) for j in range(6) if (i < j if both else i != j) and (i + j) % 4]).T]
    m = np.arange(len(v)) % 3 + 1
    arcs = pa.array([centrality._pack(v[k::2], other[k::2], m[k::2]) for k in (0, 1)], pa.binary())
    rows = []
    for block, pivots in enumerate([[], name[:2], name[2:]]):
        held = pa.record_batch([pa.array([block] * (2 + len(pivots)), pa.int32()), pa.array([*arcs.to_pylist(), *[None] * len(pivots)], pa.binary()), pa.array([None, None, *pivots], pa.int64())], ["block", "arcs", "v"])
        rows += centrality._of_pivots(iter([held]), both)
    whole = pa.Table.from_batches(rows)
    found = pa.concat_tables(centrality._added(whole.filter(pa.compute.equal(whole["chunk"], k))) for k in set(whole["chunk"].to_pylist())).to_pylist()
    found = {(r["v"], r["other"]): r["part"] for r in found}
    ids, through, flow = centrality._dependencies(*((np.concatenate(x) for x in ((v, other), (other, v), (m, m))) if both else (v, other, m)), name)
    flow = flow[: len(v)] + flow[len(v) :] if both else flow
    every = dict(zip(zip(ids.tolist(), ids.tolist()), through)) | dict(zip(zip(v.tolist(), other.tolist()), flow))
    assert found == pytest.approx({k: x for k, x in every.items() if x})


def test_block_models(spark):
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, grp long")
    d, u = graph(spark, 3, [(0, 1), (1, 0), (0, 2), (2, 2)]), graph(spark, 3, [(0, 1), (0, 2), (2, 2)]).undirected()
    first = lambda df: df.first()[0]
    assert first(blockmodel.entropy(d, part, False)) == pytest.approx(4 * math.log(2))
    assert first(blockmodel.entropy(d, part, True)) == pytest.approx(math.log(12))
    assert first(blockmodel.edges_dl(d, part)) == pytest.approx(math.log(35)) and first(blockmodel.edges_dl(u, part)) == pytest.approx(math.log(10))
    assert first(blockmodel.partition_dl(part)) == pytest.approx(math.log(18))
    assert first(blockmodel.partition_dl(part.limit(0))) == 0
    rows = {(r.r, r.s): r.m for r in blockmodel.pair_counts(u, part).collect()}
    assert rows == {(0, 0): 1, (0, 1): 1, (1, 1): 1}
    assert sorted(tuple(r) for r in blockmodel.group_totals(u, part).collect()) == [(0, 2, 3, 0), (1, 1, 3, 0)]


@pytest.mark.parametrize("undirected", [False, True])
@pytest.mark.parametrize("deg_corr", [False, True])
def test_prices_add_up(spark, undirected, deg_corr):
    rng = random.Random(7)
    g = graph(spark, 20, [(rng.randrange(20), rng.randrange(20)) for _ in range(60)])
    g = g.undirected() if undirected else g
    part = spark.createDataFrame([(i, rng.randrange(4)) for i in range(20)], "id long, grp long")
    before = blockmodel.entropy(g, part, deg_corr).first()[0]
    found = blockmodel.sweep(g, part, 4, beta=0.5, n_iter=2, seed=3, deg_corr=deg_corr)
    assert found.n_moves > 0
    assert blockmodel.entropy(g, found.partition, deg_corr).first()[0] - before == pytest.approx(found.d_entropy, abs=1e-8)
