"""Components, strong components, and the largest of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, NotDirectedError
from ..plans.superstep import Loop, numbered


def least_ancestors(g: Graph, undirected: bool = False, among: DataFrame | None = None) -> DataFrame:
    """(id, root): the smallest vertex from which each is reached. Undirected: the smallest of its component.

    Labels travel along edges; where edges lead both ways they also jump to their label's label, so that the number of
    supersteps grows with the logarithm of a long path's length.
    """
    loop = Loop(g.vertices.sparkSession)
    both = undirected or g.direction == "undirected"
    along = (g.incidence() if both else g.out()).select("v", "other").where("v <> other").distinct()
    along = loop.fixed(along, "out")
    state = loop.step(g.vertices.select("id", F.col("id").alias("root"), F.lit(True).alias("changed")))
    while True:
        offers = state.where("changed").join(along, state["id"] == along["v"]).groupBy(F.col("other").alias("id")).agg(F.min("root").alias("offer"))
        nxt = state.select("id", F.col("root").alias("was")).join(offers, "id", "left").select("id", "was", F.least("was", F.coalesce("offer", "was")).alias("root"))
        if both:
            nxt = loop.step(nxt)
            jump = nxt.select(F.col("id").alias("root"), F.col("root").alias("far"))
            nxt = nxt.join(jump, "root", "left").select("id", "was", F.least("root", F.coalesce("far", "root")).alias("root"))
        state = loop.step(nxt.select("id", "root", (F.col("root") < F.col("was")).alias("changed")))
        if state.where("changed").isEmpty():
            return state.select("id", "root")


def components(g: Graph) -> DataFrame:
    """(id, root, size): the component of every vertex, named by its smallest vertex.

    Undirected views have connected components. On directed ones the classes are those of out-reachability: vertices
    taken in ascending order, each not yet reached starts a class of all that it newly reaches; the class of a vertex is
    that of its smallest ancestor.
    """
    roots = least_ancestors(g)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return roots.join(sizes, "root").select("id", "root", "size")


def labels(found: DataFrame) -> DataFrame:
    """(id, label): classes numbered from 0 on in order of their root."""
    ranked = numbered(found.select("root").distinct(), ["root"], "label")
    return found.join(ranked, "root").select("id", "label")


def strong_labels(g: Graph, found: DataFrame) -> DataFrame:
    """(id, label): strong components(id, root) numbered from 0 on in reverse topological order, sinks first.

    An edge between components leads to a smaller label. Of all such orders it is the one by the most edges on a path to
    a sink, then by root: what a traversal by another order of edges may number otherwise.
    """
    r = found.select("id", "root")
    ends = g.edges.select("src", "dst").join(r.select(F.col("id").alias("src"), F.col("root").alias("a")), "src").join(r.select(F.col("id").alias("dst"), F.col("root").alias("b")), "dst")
    arcs = ends.where("a <> b").select(F.col("b").alias("src"), F.col("a").alias("dst")).distinct().withColumn("edge_id", F.lit(0).cast("long"))
    from .topology import topological_levels

    level = topological_levels(Graph(r.select(F.col("root").alias("id")).distinct(), arcs, g.vertex_bound, 0))
    ranked = numbered(level, ["level", "id"], "label").select(F.col("id").alias("root"), "label")
    return r.join(ranked, "root").select("id", "label")


def largest_component(g: Graph) -> DataFrame:
    """(id, inside) of every slot: whether it is in the largest component, of equal ones that with the smallest root."""
    found = components(g)
    best = found.select("root", "size").distinct().orderBy(F.desc("size"), "root").limit(1).select("root")
    inside = found.join(F.broadcast(best), "root", "left_semi").select("id", F.lit(1).alias("inside"))
    return g.densify(inside, "inside", 0)


def strong_components(g: Graph) -> DataFrame:
    """(id, root): vertices that reach each other, named by the smallest of them. Directed views only.

    By rounds over what is left: a vertex without out- or in-edges is a class alone. Of the rest, each takes the
    smallest vertex that reaches it as colour; what reaches a colour's vertex inside the colour is its class.
    """
    if g.direction == "undirected":
        raise NotDirectedError("strong components need directions")
    spark = g.vertices.sparkSession
    loop, rounds = Loop(spark), 0
    left = g.vertices.select("id")
    edges = loop.fixed(g.edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    done = []
    while True:
        rounds += 1
        here = Graph(left, edges.withColumn("edge_id", F.lit(0).cast("long")), g.vertex_bound, 0)
        colour = loop.fixed(least_ancestors(here), f"colour-{rounds}")
        # inside a colour, back along edges from its vertex
        inside = edges.join(colour.select(F.col("id").alias("src"), F.col("root").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("root").alias("cd")), "dst").where("cs = cd")
        inside = loop.fixed(inside.select("src", "dst"), f"inside-{rounds}")
        back = Loop(spark)
        found = back.step(colour.where("id = root").select("id", F.lit(0).alias("depth")))
        depth = 0
        while True:
            front = found.where(F.col("depth") == depth).select(F.col("id").alias("dst"))
            new = front.join(inside, "dst").select(F.col("src").alias("id")).distinct().join(found.select("id"), "id", "left_anti")
            depth += 1
            found = back.step(found.unionByName(new.withColumn("depth", F.lit(depth))))
            if found.where(F.col("depth") == depth).isEmpty():
                break
        own = loop.fixed(found.select("id").join(colour, "id"), f"class-{rounds}")
        done.append(own)
        left = loop.fixed(left.join(own, "id", "left_anti"), f"left-{rounds}")
        if left.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        edges = loop.fixed(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), f"edges-{rounds}")
