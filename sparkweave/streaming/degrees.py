"""Degrees of a stream of edges, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree) of a streaming frame (src, dst), for output modes update and complete.

    Spark keeps the counts as state by vertex, summed in each task before the shuffle. The state grows with the
    vertices, not with the edges.
    """
    one = lambda c, o, i: F.struct(F.col(c).alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    halves = edges.select(F.explode(F.array(one("src", 1, 0), one("dst", 0, 1))).alias("h")).select("h.*")
    return halves.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))
