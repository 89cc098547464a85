"""Degrees, weighted degrees and their histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def degrees(g: Graph, weight: str | float | None = None) -> DataFrame:
    """id, out_degree, in_degree, degree, and weighted_ forms of each if weight is given; loops count twice in degree.

    weight is a column of the edges, or a constant, for which a count is multiplied once.
    """
    w = F.lit(None) if weight is None else F.col(weight).cast("double") if isinstance(weight, str) else F.lit(1.0)
    halves = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("h"), w.alias("w"))
    sums = [F.sum("h.o").alias("out_degree"), F.sum("h.i").alias("in_degree"), F.count(F.lit(1)).alias("degree")]
    names = ["out_degree", "in_degree", "degree"]
    if isinstance(weight, str):
        sums += [F.sum(F.when(F.col("h.o") == 1, F.col("w"))).alias("weighted_out_degree"), F.sum(F.when(F.col("h.i") == 1, F.col("w"))).alias("weighted_in_degree"), F.sum("w").alias("weighted_degree")]
    found = halves.groupBy(F.col("h.id").alias("id")).agg(*sums)
    out = g.vertices.select("id").join(found, "id", "left")
    out = out.select("id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in names], *[F.coalesce(F.col(f"weighted_{c}"), F.lit(0.0)).alias(f"weighted_{c}") for c in names if isinstance(weight, str)])
    if weight is not None and not isinstance(weight, str):
        out = out.select("*", *[(F.col(c) * F.lit(float(weight))).alias(f"weighted_{c}") for c in names])
    if g.direction == "undirected":
        plain = [c for c in out.columns if not c.endswith(("out_degree", "in_degree"))]
        out = out.select(*plain)
    return out


def out_degrees(g: Graph) -> DataFrame:
    """(id, out_degree) of every slot under the bound; 0 for those that are no vertex."""
    counts = g.out().groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return g.densify(counts.join(g.vertices.select("id"), "id", "left_semi"), "out_degree", 0)


def degree_histogram(g: Graph) -> DataFrame:
    """(degree, count) for 0 up to the largest degree; no rows for an empty graph."""
    d = degrees(g).groupBy("degree").agg(F.count(F.lit(1)).alias("count"))
    most = d.agg(F.max("degree").alias("m")).where("m IS NOT NULL")
    every = most.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("degree"))
    return every.join(d, "degree", "left").select("degree", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def sum_property(g: Graph, column: str, of: str = "vertex") -> DataFrame:
    """One row: the sum of a numeric column as a double; unset slots are 0."""
    frame = g.vertices if of == "vertex" else g.edges
    return frame.agg(F.coalesce(F.sum(F.col(column).cast("double")), F.lit(0.0)).alias("total"))


def det_sum(df: DataFrame, column: str, by: str, grain: int = 1024) -> DataFrame:
    """The sum of a column, folded in a fixed order: within chunks of `grain` ids by id, then over the chunks.

    The result doesn't depend on partitions or threads. A task folds a chunk at a time; the chunks' sums, one in
    `grain` of the rows, are folded again in the same way until one is left.
    """
    ids, level = df.select(F.col(by).cast("long").alias("k"), F.col(column).cast("double").alias("x")), 0
    n = df.agg(F.max(by)).first()[0]
    while True:
        fold = F.aggregate(F.sort_array(F.collect_list(F.struct("k", "x"))), F.lit(0.0), lambda a, p: a + p["x"])
        ids = ids.groupBy(F.floor(F.col("k") / grain).cast("long").alias("k")).agg(fold.alias("x"))
        n = (n or 0) // grain
        level += 1
        if n == 0 or level > 8:
            return ids.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"))
