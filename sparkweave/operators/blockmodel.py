"""Stochastic block models: aggregates of a partition, entropy, description lengths, prices of moves, and sweeps."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import lbinom, lgamma1p, safelog
from ..graph import Graph
from ..plans.superstep import Loop


def pair_counts(g: Graph, partition: DataFrame) -> DataFrame:
    """(r, s, m): edges between groups of partition(id, grp); r <= s on undirected views."""
    b = partition.select("id", "grp")
    e = g.edges.join(b.select(F.col("id").alias("src"), F.col("grp").alias("x")), "src").join(b.select(F.col("id").alias("dst"), F.col("grp").alias("y")), "dst")
    r, s = (F.least("x", "y"), F.greatest("x", "y")) if g.direction == "undirected" else (F.col("x"), F.col("y"))
    return e.groupBy(r.alias("r"), s.alias("s")).agg(F.count(F.lit(1)).alias("m"))


def group_totals(g: Graph, partition: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(grp, wr, mrp, mrm): vertices of each occupied group, its edge ends going out and coming in; undirected all in mrp, loops twice."""
    pairs = pair_counts(g, partition) if pairs is None else pairs
    wr = partition.groupBy("grp").agg(F.sum("vweight" if "vweight" in partition.columns else F.lit(1)).cast("long").alias("wr"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("r").alias("grp"), F.col("m").alias("p"), F.lit(0).cast("long").alias("q")), F.struct(F.col("s").alias("grp"), F.lit(0).cast("long").alias("p"), F.col("m").alias("q")))).alias("e")).select("e.*")
    sums = ends.groupBy("grp").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    both = F.coalesce("p", F.lit(0)) + F.coalesce("q", F.lit(0))
    if g.direction == "undirected":
        return wr.join(sums, "grp", "left").select("grp", "wr", both.alias("mrp"), F.lit(0).cast("long").alias("mrm"))
    return wr.join(sums, "grp", "left").select("grp", "wr", F.coalesce("p", F.lit(0)).alias("mrp"), F.coalesce("q", F.lit(0)).alias("mrm"))


def pair_term(m: Column, r: Column, s: Column, directed: bool) -> Column:
    value = -lgamma1p(m)
    return value if directed else value - F.when(r == s, m * math.log(2)).otherwise(0.0)


def group_term(wr: Column, mrp: Column, mrm: Column, directed: bool, deg_corr: bool) -> Column:
    if deg_corr:
        return lgamma1p(mrp) + lgamma1p(mrm) if directed else lgamma1p(mrp)
    return ((mrp + mrm) if directed else mrp) * safelog(wr)


def dense_pair_term(m: Column, nr: Column, ns: Column, same: Column, directed: bool, multigraph: bool) -> Column:
    """The term of a pair of groups in the dense model: how many ways there are to place m edges."""
    places = nr * ns if directed else F.when(same, (nr * (nr + 1) / 2) if multigraph else (nr * (nr - 1) / 2)).otherwise(nr * ns)
    return lbinom(places + m - 1, m) if multigraph else lbinom(places, m)


def entropy(g: Graph, partition: DataFrame, deg_corr: bool = True) -> DataFrame:
    """One row: the entropy of the graph under the partition, the pairs' terms and the groups'."""
    directed = g.direction != "undirected"
    pairs = pair_counts(g, partition)
    e = pairs.agg(F.coalesce(F.sum(pair_term(F.col("m"), F.col("r"), F.col("s"), directed)), F.lit(0.0)).alias("e"))
    v = group_totals(g, partition, pairs).agg(F.coalesce(F.sum(group_term(F.col("wr"), F.col("mrp"), F.col("mrm"), directed, deg_corr)), F.lit(0.0)).alias("v"))
    return e.join(v).select((F.col("e") + F.col("v")).alias("entropy"))  # one row each


def partition_dl(partition: DataFrame) -> DataFrame:
    """One row: the description length of the partition."""
    sizes = partition.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(lgamma1p(F.col("n"))), F.lit(0.0)).alias("x"))
    value = lbinom(F.col("n") - 1, F.col("b") - 1) + lgamma1p(F.col("n")) - F.col("x") + safelog(F.col("n"))
    return sizes.select(F.when(F.col("n") == 0, F.lit(0.0)).otherwise(value).alias("partition_dl"))


def edges_dl(g: Graph, partition: DataFrame) -> DataFrame:
    """One row: the description length of the counts between groups."""
    b = partition.agg(F.countDistinct("grp").alias("b"))
    e = g.edges.agg(F.count(F.lit(1)).alias("e"))
    places = F.col("b") * F.col("b") if g.direction != "undirected" else (F.col("b") * (F.col("b") + 1) / 2).cast("long")
    return b.join(e).select(lbinom(places + F.col("e") - 1, F.col("e")).alias("edges_dl"))  # one row each


def move_deltas(g: Graph, partition: DataFrame, moves: DataFrame) -> DataFrame:
    """(move_id, r, s, d): by how many edges each move(move_id, id, to) changes each pair of groups, zeros left out.

    All moves are priced against the partition as it is, at once. A loop of the vertex moves with both its ends.
    """
    directed = g.direction != "undirected"
    b = partition.select("id", "grp")
    at = moves.join(b, "id").select("move_id", "id", F.col("grp").alias("from"), "to")
    inc = g.edges.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(True).alias("ahead")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(False).alias("ahead")))).alias("i")).select("i.*")
    inc = inc.groupBy("id", "other", "ahead").agg(F.count(F.lit(1)).alias("m"))
    steps = at.join(inc, "id").join(b.select(F.col("id").alias("other"), F.col("grp").alias("x")), "other")
    loops = g.edges.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    ends = lambda own: F.struct(F.when(F.col("ahead"), F.col(own)).otherwise(F.col("x")).alias("r"), F.when(F.col("ahead"), F.col("x")).otherwise(F.col(own)).alias("s"))
    changed = steps.select("move_id", F.explode(F.array(F.struct(ends("from").alias("p"), (-F.col("m")).alias("d")), F.struct(ends("to").alias("p"), F.col("m").alias("d")))).alias("c"))
    own = at.join(loops, "id").select("move_id", F.explode(F.array(F.struct(F.struct(F.col("from").alias("r"), F.col("from").alias("s")).alias("p"), (-F.col("m")).alias("d")), F.struct(F.struct(F.col("to").alias("r"), F.col("to").alias("s")).alias("p"), F.col("m").alias("d")))).alias("c"))
    rows = changed.union(own).select("move_id", "c.p.r", "c.p.s", "c.d")
    if not directed:
        rows = rows.select("move_id", F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s"), "d")
    return rows.groupBy("move_id", "r", "s").agg(F.sum("d").alias("d")).where("d <> 0")


def move_prices(g: Graph, partition: DataFrame, moves: DataFrame, deg_corr: bool = True) -> DataFrame:
    """(move_id, ds): the change of entropy by each move alone, from the changed pairs and the groups at their ends only."""
    directed = g.direction != "undirected"
    pairs = pair_counts(g, partition)
    totals = group_totals(g, partition, pairs)
    delta = move_deltas(g, partition, moves)
    before = F.coalesce(F.col("m"), F.lit(0))
    r, s = F.col("r"), F.col("s")
    e = delta.join(pairs, ["r", "s"], "left").groupBy("move_id").agg(F.sum(pair_term(before + F.col("d"), r, s, directed) - pair_term(before, r, s, directed)).alias("e"))
    ends = delta.select("move_id", F.explode(F.array(F.struct(r.alias("grp"), F.col("d").alias("p"), F.lit(0).cast("long").alias("q")), F.struct(s.alias("grp"), (F.lit(0).cast("long") if directed else F.col("d")).alias("p"), (F.col("d") if directed else F.lit(0).cast("long")).alias("q")))).alias("x")).select("move_id", "x.*")
    weight = F.col("vweight") if "vweight" in partition.columns else F.lit(1).cast("long")
    shift = moves.join(partition, "id").select("move_id", F.col("grp").alias("from"), "to", weight.alias("w")).where(F.col("from") != F.col("to"))
    zero = F.lit(0).cast("long")
    shifted = shift.select("move_id", F.explode(F.array(F.struct(F.col("from").alias("grp"), (-F.col("w")).alias("w")), F.struct(F.col("to").alias("grp"), F.col("w").alias("w")))).alias("x")).select("move_id", "x.grp", zero.alias("p"), zero.alias("q"), "x.w")
    touched = ends.select("move_id", "grp", "p", "q", zero.alias("w")).unionByName(shifted).groupBy("move_id", "grp").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("w").alias("w"))
    touched = touched.join(totals, "grp", "left").fillna(0, ["wr", "mrp", "mrm"])
    c = F.col
    after = group_term(c("wr") + c("w"), c("mrp") + c("p"), c("mrm") + c("q"), directed, deg_corr)
    v = touched.groupBy("move_id").agg(F.sum(after - group_term(c("wr"), c("mrp"), c("mrm"), directed, deg_corr)).alias("v"))
    found = moves.select("move_id").join(e, "move_id", "left").join(v, "move_id", "left")
    return found.select("move_id", (F.coalesce("e", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))).alias("ds"))


def uniform(*keys) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def accepted(ds: float, log_hastings: float, beta: float, draw: float) -> bool:
    """Metropolis' rule; at an infinite beta only what lowers the entropy."""
    if math.isinf(beta):
        return ds < 0
    a = -ds * beta + log_hastings
    return a > 0 or draw < math.exp(a)


@dataclass(frozen=True)
class SweepResult:
    partition: DataFrame
    d_entropy: float
    n_attempts: int
    n_moves: int


class _Blocks:
    """A partition's groups as a sweep changes them: edges between groups, edge ends and vertices of each."""

    def __init__(self, g: Graph, partition: DataFrame, deg_corr: bool):
        self.directed, self.deg_corr = g.direction != "undirected", deg_corr
        pairs = pair_counts(g, partition)
        self.m = {(r.r, r.s): r.m for r in pairs.toLocalIterator()}
        self.totals = {r.grp: (r.wr, r.mrp, r.mrm) for r in group_totals(g, partition, pairs).toLocalIterator()}

    def _pair(self, r: int, s: int) -> tuple[int, int]:
        return (r, s) if self.directed or r <= s else (s, r)

    def _pair_term(self, p: tuple[int, int], m: int) -> float:
        return -math.lgamma(m + 1) - (m * math.log(2) if not self.directed and p[0] == p[1] else 0.0)

    def _group_term(self, wr: int, mrp: int, mrm: int) -> float:
        if self.deg_corr:
            return math.lgamma(mrp + 1) + math.lgamma(mrm + 1)
        return (mrp + mrm) * (math.log(wr) if wr else 0.0)

    def price(self, old: int, new: int, weight: int, out: dict[int, int], into: dict[int, int], loops: int) -> tuple[float, dict, dict]:
        """The change of entropy if a vertex goes from old to new, and what changes; out and into: its edges by the other end's group, loops apart."""
        delta: dict[tuple[int, int], int] = {}
        for grp, sign in ((old, -1), (new, 1)):
            for x, k in out.items():
                p = self._pair(grp, x)
                delta[p] = delta.get(p, 0) + sign * k
            for x, k in into.items():
                p = self._pair(x, grp)
                delta[p] = delta.get(p, 0) + sign * k
            if loops:
                delta[grp, grp] = delta.get((grp, grp), 0) + sign * loops
        ahead, back = sum(out.values()) + loops, sum(into.values()) + loops
        ends = (ahead, back) if self.directed else (ahead + back, 0)
        groups = {}
        for grp, sign in ((old, -1), (new, 1)):
            wr, mrp, mrm = self.totals.get(grp, (0, 0, 0))
            groups[grp] = (wr + sign * weight, mrp + sign * ends[0], mrm + sign * ends[1])
        after = {p: self.m.get(p, 0) + d for p, d in delta.items() if d}
        ds = sum(self._pair_term(p, m) - self._pair_term(p, self.m.get(p, 0)) for p, m in after.items())
        ds += sum(self._group_term(*t) - self._group_term(*self.totals.get(grp, (0, 0, 0))) for grp, t in groups.items())
        return ds, after, groups

    def perform(self, after: dict, groups: dict) -> None:
        self.m.update(after)
        self.totals.update(groups)


def sweep(g: Graph, partition: DataFrame, n_groups: int, beta: float = 1.0, n_iter: int = 1, seed: int = 0, deg_corr: bool = True) -> SweepResult:
    """Sweeps in which every vertex, in a drawn order, is proposed a group drawn evenly.

    Each move is priced and decided against the partition that the moves before it left, and every accepted move is
    made. That is a sequence: vertices come to the driver in order, a partition at a time, with their edges put together
    by neighbour; the driver holds each vertex's group and the counts of the groups, never all edges. Draws depend on
    seed, sweep and vertex alone.
    """
    spark = g.vertices.sparkSession
    loop = Loop(spark)
    state = loop.step(partition)
    ids = state.select("id")
    edges = g.edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), one.alias("p"), none.alias("q")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), none.alias("p"), one.alias("q")))).alias("i")).select("i.*")
    near = ends.groupBy("id", "other").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).groupBy("id").agg(F.collect_list(F.struct("other", "p", "q")).alias("near"))
    weight = F.col("vweight").cast("long") if "vweight" in partition.columns else one
    near = loop.fixed(state.select("id", weight.alias("weight")).join(near, "id", "left"), "near")
    blocks = _Blocks(g, state, deg_corr)
    grp = {r.id: r.grp for r in state.select("id", "grp").toLocalIterator()}
    total, tried, made = 0.0, 0, 0
    for t in range(n_iter):
        key = F.col("id")
        turns = near.select("id", "weight", "near", F.floor(uniform(seed, t, key, 1) * n_groups).cast("long").alias("to"), uniform(seed, t, key, 2).alias("draw"), uniform(seed, t, key, 3).alias("turn"))
        for r in turns.orderBy("turn", "id").toLocalIterator():
            old = grp[r.id]
            if r.to == old:
                continue
            tried += 1
            out, into, loops = {}, {}, 0
            for other, p, q in r.near or []:
                if other == r.id:
                    loops = p
                    continue
                x = grp[other]
                if p:
                    out[x] = out.get(x, 0) + p
                if q:
                    into[x] = into.get(x, 0) + q
            ds, after, groups = blocks.price(old, r.to, r.weight, out, into, loops)
            if accepted(ds, 0.0, beta, r.draw):
                blocks.perform(after, groups)
                grp[r.id] = r.to
                total, made = total + ds, made + 1
    found = spark.createDataFrame(list(grp.items()), "id long, now long")
    state = loop.fixed(state.join(found, "id").select(*[F.col("now").alias("grp") if c == "grp" else c for c in partition.columns]), "found")
    return SweepResult(state, total, tried, made)
