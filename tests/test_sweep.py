"""Sweeps of the block model: every accepted move is made, one after the other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkweave.graph import Graph
from sparkweave.operators import blockmodel


def graph(spark, n, edges):
    rows = [(i, a, b) for i, (a, b) in enumerate(edges)]
    return Graph(spark.range(n).select("id"), spark.createDataFrame(rows, "edge_id long, src long, dst long"), n, len(edges))


def random_case(spark, n, m, seed):
    rng = random.Random(seed)
    part = spark.createDataFrame([(i, rng.randrange(4)) for i in range(n)], "id long, grp long")
    return graph(spark, n, [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]), part


@pytest.mark.parametrize("undirected", [False, True])
def test_every_proposal_stands_where_all_are_accepted(spark, undirected):
    g, part = random_case(spark, 40, 160, 2)
    g = g.undirected() if undirected else g
    found = blockmodel.sweep(g, part, 4, beta=0.0, seed=1)
    assert found.n_moves == found.n_attempts > 20
    before, after = ({r.id: r.grp for r in p.collect()} for p in (part, found.partition))
    assert sum(before[i] != after[i] for i in range(40)) == found.n_moves


@pytest.mark.parametrize("deg_corr", [False, True])
@pytest.mark.parametrize("undirected", [False, True])
def test_sweep_against_recomputed_entropies(spark, undirected, deg_corr):
    """Each vertex in its turn, priced by two full entropies in plain Python."""
    n, seed, beta = 12, 9, 0.7
    g, part = random_case(spark, n, 45, 4)
    edges = [(r.src, r.dst) for r in g.edges.collect()]
    g = g.undirected() if undirected else g

    def entropy(b):
        m, out, into, size = {}, {}, {}, {}
        for x, y in edges:
            p = (b[x], b[y]) if not undirected else tuple(sorted((b[x], b[y])))
            m[p] = m.get(p, 0) + 1
            out[b[x]] = out.get(b[x], 0) + 1
            into[b[y]] = into.get(b[y], 0) + 1
        for x in b.values():
            size[x] = size.get(x, 0) + 1
        h = sum(-math.lgamma(k + 1) - (k * math.log(2) if undirected and r == s else 0) for (r, s), k in m.items())
        for x, k in size.items():
            p, q = out.get(x, 0), into.get(x, 0)
            p, q = (p + q, 0) if undirected else (p, q)
            h += math.lgamma(p + 1) + math.lgamma(q + 1) if deg_corr else (p + q) * math.log(k)
        return h

    draws = spark.range(n).select("id", *[blockmodel.uniform(seed, 0, F.col("id"), k).alias(f"u{k}") for k in (1, 2, 3)]).collect()
    b, moves = {r.id: r.grp for r in part.collect()}, 0
    for r in sorted(draws, key=lambda r: (r.u3, r.id)):
        to = math.floor(r.u1 * 4)
        if to == b[r.id]:
            continue
        ds = entropy(b | {r.id: to}) - entropy(b)
        if -ds * beta > 0 or r.u2 < math.exp(-ds * beta):
            b[r.id], moves = to, moves + 1
    found = blockmodel.sweep(g, part, 4, beta=beta, seed=seed, deg_corr=deg_corr)
    assert {r.id: r.grp for r in found.partition.collect()} == b and found.n_moves == moves
