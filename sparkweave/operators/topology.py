"""Orders, colourings, triangles, reciprocity and cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, NotDirectedError
from ..plans.superstep import Loop
from .components import least_ancestors
from .traversal import bfs


def topological_levels(g: Graph) -> DataFrame:
    """(id, level) of the vertices that no cycle holds back: the most edges on a path to it. (level, id) is a topological order."""
    if g.direction == "undirected":
        raise NotDirectedError("an undirected view has no topological order")
    loop = Loop(g.vertices.sparkSession)
    edges = loop.fixed(g.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")), "edges")
    held = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("held"))
    state = loop.step(g.vertices.select("id").join(held, "id", "left").select("id", F.coalesce("held", F.lit(0)).alias("held"), F.when(F.coalesce("held", F.lit(0)) == 0, F.lit(0)).alias("level")))
    level = 0
    while True:
        freed = state.where(F.col("level") == level).select(F.col("id").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("m"))
        left = F.col("held") - F.coalesce("m", F.lit(0))
        state = loop.step(state.join(freed, "id", "left").select("id", left.alias("held"), F.coalesce("level", F.when(left == 0, F.lit(level + 1))).alias("level")))
        level += 1
        if state.where(F.col("level") == level).isEmpty():
            return state.where("level IS NOT NULL").select("id", "level")


def is_dag(g: Graph) -> bool:
    """Whether there is no directed cycle, loops included; an undirected view has none only without edges."""
    if g.direction == "undirected":
        return g.edges.isEmpty()
    return topological_levels(g).count() == g.num_vertices()


def topological_sort(g: Graph) -> DataFrame | None:
    """(id, level) of all vertices, whose order by (level, id) puts every edge's source before its target; None with a cycle."""
    found = topological_levels(g)
    return found if found.count() == g.num_vertices() else None


def bipartition(g: Graph) -> DataFrame | None:
    """(id, colour) of every slot: 1 for each component's smallest vertex, alternating with 0; None with an odd cycle."""
    und = g if g.direction == "undirected" else g.undirected()
    loop = Loop(g.vertices.sparkSession)
    roots = loop.fixed(least_ancestors(und).where("id = root").select("id"), "roots")
    parity = loop.fixed(bfs(und, roots).select("id", (1 - F.col("depth") % 2).cast("int").alias("colour")), "parity")
    ends = g.edges.join(parity.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(parity.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst")
    return g.densify(parity, "colour", 0) if ends.where("a = b").isEmpty() else None


def simple_pairs(g: Graph) -> DataFrame:
    """(a, b) with a < b: the simple undirected graph below."""
    return g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def count_triangles(g: Graph) -> DataFrame:
    """One row: the triangles of the simple graph, each once.

    Pairs point from the end of smaller degree, ties by id, to the other; so no vertex has more than the square root of
    twice the pairs as out-neighbours, and hubs make few paths of two.
    """
    pairs = simple_pairs(g)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    d = pairs.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    points = d.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    two = points.select("u", "v").join(points.select("u", F.col("v").alias("w")), "u").where("v < w").select(F.col("v").alias("a"), F.col("w").alias("b"))
    return two.join(pairs, ["a", "b"]).agg(F.count(F.lit(1)).alias("triangles"))


def global_clustering(g: Graph) -> DataFrame:
    """One row: three times the triangles by the paths of two; NaN without those."""
    ends = simple_pairs(g).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    triples = ends.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)).alias("triples"))
    both = count_triangles(g).join(triples)  # one row each
    return both.select(F.when(F.col("triples") > 0, F.try_divide(3.0 * F.col("triangles"), "triples")).otherwise(F.lit(float("nan"))).alias("clustering"))


def reciprocity(g: Graph) -> DataFrame:
    """One row: the share of edges, loops apart, that an edge the other way answers, parallel ones each by one; NaN without edges."""
    if g.direction == "undirected":
        raise NotDirectedError("reciprocity needs directions")
    m = g.edges.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    back = m.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("m").alias("back"))
    sums = m.join(back, ["src", "dst"], "left").agg(F.sum(F.least("m", F.coalesce("back", F.lit(0)))).alias("x"), F.sum("m").alias("y"))
    return sums.select(F.when(F.col("y") > 0, F.try_divide(F.col("x").cast("double"), "y")).otherwise(F.lit(float("nan"))).alias("reciprocity"))


def core_numbers(g: Graph) -> DataFrame:
    """(id, core) of every slot by total degree, parallel edges counted and loops twice; -1 for slots that are no vertex.

    Supersteps peel all vertices of at most k remaining incidences at once, then k rises to the least that is left.
    """
    loop = Loop(g.vertices.sparkSession)
    inc = loop.fixed(g.incidence().groupBy("v", "other").agg(F.count(F.lit(1)).alias("m")), "incidence")
    total = inc.groupBy(F.col("v").alias("id")).agg(F.sum("m").alias("d"))
    state = loop.step(g.vertices.select("id").join(total, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"), F.lit(None).cast("long").alias("core"), F.lit(False).alias("fresh")))
    k = 0
    while True:
        row = state.where("core IS NULL").agg(F.min("d")).first()
        if row[0] is None:
            return g.densify(state, "core", -1)
        k = max(k, row[0])
        peel = F.col("core").isNull() & (F.col("d") <= k)
        state = loop.step(state.select("id", "d", F.when(peel, F.lit(k).cast("long")).otherwise(F.col("core")).alias("core"), peel.alias("fresh")))
        lost = state.where("fresh").select(F.col("id").alias("v")).join(inc.where("v <> other"), "v").groupBy(F.col("other").alias("id")).agg(F.sum("m").alias("m"))
        state = loop.step(state.join(lost, "id", "left").select("id", F.when(F.col("core").isNull(), F.col("d") - F.coalesce("m", F.lit(0))).otherwise(F.col("d")).alias("d"), "core", F.lit(False).alias("fresh")))
