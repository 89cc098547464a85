"""Breadth-first traversal, hop distances and shortest paths, by frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, GraphError
from ..plans.superstep import Loop

UNREACHABLE = 2**63 - 1


def bfs(g: Graph, sources: list[int] | DataFrame, prune_vertex: Column | None = None, prune_edge: Column | None = None, max_depth: int | None = None, stop: Column | None = None) -> DataFrame:
    """(id, depth) of every vertex reached from the sources, which are at depth 0.

    prune_vertex, over id and depth: such vertices are reached but not left; prune_edge, over v, other and the edge's
    columns: such incidences are not followed; stop, over id and depth: the depth at which such a vertex is reached is the
    last. A source that a filter took away may still be started from. A superstep writes the vertices that it reached, and
    no others.
    """
    spark = g.vertices.sparkSession
    start = sources if isinstance(sources, DataFrame) else spark.createDataFrame([(int(s),) for s in sources], "id long")
    if not isinstance(sources, DataFrame) and any(s < 0 or s >= g.vertex_bound for s in sources):
        raise GraphError("no such vertex")
    loop = Loop(spark)
    along = g.anchored()
    if prune_edge is not None:
        along = along.where(~prune_edge)
    along = loop.fixed(along.select("v", "other").distinct(), "out")
    front = loop.fixed(start.select(F.col("id").cast("long").alias("id")).distinct().withColumn("depth", F.lit(0).cast("long")), "reached-0")
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        if stop is not None and not front.where(stop).isEmpty():
            break
        goes_on = front if prune_vertex is None else front.where(~prune_vertex)
        new = goes_on.join(along, goes_on["id"] == along["v"]).select(F.col("other").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        depth += 1
        front = loop.fixed(new.withColumn("depth", F.lit(depth).cast("long")), f"reached-{depth}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % 32 == 0:  # a plan of many small tables is put together now and then
            seen = loop.fixed(seen, f"seen-{depth}")
    return seen


def shortest_distances(g: Graph, source: int) -> DataFrame:
    """(id, distance) in hops of every slot under the bound; UNREACHABLE where there is no path."""
    reached = _inside(g, bfs(g, [source]))
    return g.densify(reached.withColumnRenamed("depth", "distance"), "distance", UNREACHABLE)


def _inside(g: Graph, found: DataFrame) -> DataFrame:
    """Without a source that a filter took away."""
    return found if g.entries is None else found.join(g.vertices.select("id"), "id", "left_semi")


def dijkstra(g: Graph, source: int, weight: str | None = None) -> DataFrame:
    """(id, distance) by the sum of weights along the best path, of every slot; infinite where there is none.

    Without weight hops count. Weights must not be negative. Each superstep relaxes what the last one changed; path
    sums are taken from the source on, so that distances don't depend on the order of steps.
    """
    if weight is None:
        hops = bfs(g, [source]).select("id", F.col("depth").cast("double").alias("distance"))
        return g.densify(_inside(g, hops), "distance", float("inf"))
    spark = g.vertices.sparkSession
    if source < 0 or source >= g.vertex_bound:
        raise GraphError("no such vertex")
    if not g.edges.where((F.col(weight) < 0) | F.isnan(F.col(weight).cast("double"))).isEmpty():
        raise ValueError("a weight is negative")
    loop = Loop(spark)
    # of parallel edges only the lightest can be on a best path
    along = loop.fixed(g.anchored().groupBy("v", "other").agg(F.min(F.col(weight).cast("double")).alias("w")), "out")
    state = loop.step(spark.createDataFrame([(source, 0.0, True)], "id long, distance double, changed boolean"))
    while True:
        front = state.where("changed")
        offers = front.join(along, front["id"] == along["v"]).groupBy(F.col("other").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("distance").isNull() | (F.col("offer") < F.col("distance")))
        nxt = state.select("id", "distance").join(offers, "id", "full").select("id", F.when(better, F.col("offer")).otherwise(F.col("distance")).alias("distance"), better.alias("changed"))
        state = loop.step(nxt)
        if state.where("changed").isEmpty():
            return g.densify(_inside(g, state), "distance", float("inf"))


def depth_first(g: Graph, source: int, discover=None, finish=None) -> DataFrame:
    """(order, id, depth) of a depth-first traversal from source, each vertex's edges by id; callbacks as for dfs.

    Such a traversal is a sequence: the driver reads the out-edges of a vertex when it gets there, and holds those of the
    vertices on its path and the ids it has seen, never all edges.
    """
    spark = g.vertices.sparkSession
    if source < 0 or source >= g.vertex_bound:
        raise GraphError("no such vertex")
    along = Loop(spark).fixed(g.anchored().select("v", "other", "edge_id").repartitionByRange("v").sortWithinPartitions("v"), "out")

    class Edges(dict):
        def get(self, v, default=()):
            rows = along.where(F.col("v") == v).orderBy("edge_id", "other").select("other").collect()
            return [r[0] for r in rows] or default

    rows = [(k, v, d) for k, (v, d) in enumerate(dfs(Edges(), source, discover, finish))]
    return spark.createDataFrame(rows, "order long, id long, depth long")


def dfs(neighbours: dict[int, list[int]], source: int, discover=None, finish=None) -> list[tuple[int, int]]:
    """Pre-order (id, depth) of a depth-first traversal of an adjacency that fits one task; callbacks get id and depth.

    discover may return "prune" not to go on from a vertex, which is then never finished, or "stop" to end.
    """
    seen, out, stack = {source}, [], []

    def enter(v, depth):
        out.append((v, depth))
        said = discover(v, depth) if discover else None
        if said != "prune":
            stack.append((v, depth, iter(neighbours.get(v, ()))))
        return said == "stop"

    if enter(source, 0):
        return out
    while stack:
        v, depth, rest = stack[-1]
        for u in rest:
            if u not in seen:
                seen.add(u)
                if enter(u, depth + 1):
                    return out
                break
        else:
            stack.pop()
            if finish and finish(v, depth) == "stop":
                return out
    return out
