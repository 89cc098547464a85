"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """id and component, the smallest id it is linked with, for every id in edges(a, b); loops and repeats are harmless.

    Alternating large-star and small-star rounds: each links what a node sees to the smallest node it sees, by a minimum
    that is aggregated map-side and a join, so no neighbourhood is ever gathered in one place. Rounds are written to the
    shared folder; they end when a round changes nothing, after a number that grows with the logarithm of the size.
    """

    def rooted(pairs: DataFrame, up: bool) -> DataFrame:
        """Each node's smallest neighbour, itself included; up: link to it the larger neighbours, else the smaller and itself."""
        both = pairs.union(pairs.select("b", "a")) if up else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        if up:
            least = least.select("a", F.least("a", "m").alias("m"))
            out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = both.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    # every edge points from the larger to the smaller node
    now = work.save(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct(), name)
    mark = None
    while True:
        path = work.paths[name][-1:]
        nxt = work.save(rooted(rooted(now, True), False), name)
        row = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        old = [p for p in work.paths[name][:-1] if p in path]
        work.paths[name] = work.paths[name][-1:]
        work.paths.setdefault(f"{name}-old", []).extend(old)
        work.drop(f"{name}-old")
        now = nxt
        if (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
