"""Graphs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .plans.superstep import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_seq(spark: SparkSession, sf_dir: str) -> Graph:
    """events: each user to the next event's, in order of time; the edge's weight is the event's value."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    e = numbered(e, ["ts", "event_id"], "edge_id")
    follow = e.select((F.col("edge_id") - 1).alias("edge_id"), F.col("user_id").alias("dst"))
    e = e.join(follow, "edge_id")
    return Graph.from_edges(e.select("edge_id", F.col("user_id").alias("src"), "dst", F.col("value").alias("weight")))


def supp_part(spark: SparkSession, sf_dir: str) -> Graph:
    """lineitem: supplier (even ids) to part (odd ids), weighted by quantity. Edge ids have gaps, as none are needed."""
    li = table(spark, sf_dir, "lineitem")
    return Graph.from_edges(li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_id"), (F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.col("l_quantity").alias("weight")))


def geo(spark: SparkSession, sf_dir: str) -> Graph:
    """region to nation to customer and supplier: a forest. Ids are 4 * key + 0 to 3 in that order."""
    n, c, s = (table(spark, sf_dir, x) for x in ("nation", "customer", "supplier"))
    e = n.select((F.col("n_regionkey") * 4).alias("src"), (F.col("n_nationkey") * 4 + 1).alias("dst"))
    e = e.unionByName(c.select((F.col("c_nationkey") * 4 + 1).alias("src"), (F.col("c_custkey") * 4 + 2).alias("dst")))
    e = e.unionByName(s.select((F.col("s_nationkey") * 4 + 1).alias("src"), (F.col("s_suppkey") * 4 + 3).alias("dst")))
    return Graph.from_edges(e.select(F.col("dst").alias("edge_id"), "src", "dst"))  # in a forest an edge goes by its target


def later(g: Graph) -> Graph:
    """Only edges to a larger vertex: a graph without cycles."""
    return g.filtered(edge=F.col("src") < F.col("dst"))


def blocks(g: Graph, n: int = 8) -> DataFrame:
    """A partition (id, grp) by the remainder of the id."""
    return g.vertices.select("id", F.pmod("id", F.lit(n)).cast("long").alias("grp"))
