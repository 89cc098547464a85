"""Block-model states that change by recorded, priced and committed moves, and their audits."""

from __future__ import annotations

import math
import uuid
from abc import ABC, abstractmethod
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.superstep import Loop
from . import blockmodel as B


class StampMismatchError(ValueError):
    """A move was recorded on another state, or before the last commit."""


class OutOfPlaneError(ValueError):
    """A group has no group on the next level."""


class AuditError(AssertionError):
    """What a state holds isn't what its graph and partition give."""


@dataclass(frozen=True)
class EntropyParams:
    """Which entropy prices moves: degree-corrected or not, and of multigraphs in the dense model."""

    deg_corr: bool = True
    multigraph: bool = True


class Schedule(Enum):
    """How a sweep orders vertices: drawn one by one with replacement, all once in a drawn order, all once in theirs."""

    RANDOM = "random"
    SHUFFLED = "shuffled"
    ALTERNATING = "alternating"

    def turns(self, vertices: DataFrame, seed: int, sweep: int) -> DataFrame:
        """(turn, id): the vertices of a sweep; turn orders them. As many turns as vertices."""
        key = F.col("id")
        if self is Schedule.SHUFFLED:
            return vertices.select(B.uniform(seed, sweep, key, 3).alias("turn"), "id")
        if self is Schedule.ALTERNATING:
            return vertices.select(F.col("id").cast("double").alias("turn"), "id")
        from ..plans.superstep import numbered

        ranked, n = numbered(vertices.select("id"), ["id"], "k"), vertices.count()
        drawn = vertices.sparkSession.range(n).select((F.col("id").cast("double")).alias("turn"), F.floor(B.uniform(seed, sweep, key, 4) * n).cast("long").alias("k"))
        return drawn.join(ranked, "k").select("turn", "id")


class MetropolisState(ABC):
    """What a Metropolis loop asks of a state: a move for a vertex, what it costs, and to make it."""

    @abstractmethod
    def propose(self, v: int, draw: float) -> tuple[object, int] | None:
        """A move and the elementary steps it stands for, or None to skip the vertex."""

    @abstractmethod
    def score(self, v: int, move) -> tuple[float, float]:
        """The change of entropy, and the log of the Hastings ratio."""

    @abstractmethod
    def perform(self, v: int, move) -> None: ...


class GroupProposal(ABC):
    """Proposals of groups with their probabilities."""

    @abstractmethod
    def propose(self, v: int, draw: float) -> int: ...

    @abstractmethod
    def log_forward(self, v: int, to: int) -> float: ...

    @abstractmethod
    def log_reverse(self, v: int, to: int) -> float: ...

    def log_hastings(self, v: int, to: int) -> float:
        return self.log_reverse(v, to) - self.log_forward(v, to)


def metropolis(state: MetropolisState, turns: list[tuple[int, float, float]], beta: float) -> tuple[float, int, int]:
    """Change of entropy, attempts and moves of a loop over turns (vertex, draw for the proposal, draw for the decision)."""
    total, tried, made = 0.0, 0, 0
    for v, draw, chance in turns:
        step = state.propose(v, draw)
        if step is None:
            continue
        move, steps = step
        tried += steps
        ds, hastings = state.score(v, move)
        if B.accepted(ds, hastings, beta, chance):
            state.perform(v, move)
            total, made = total + ds, made + steps
    return total, tried, made


@dataclass
class Transition:
    """A recorded move, or several at once of different vertices: deltas(move_id, r, s, d) and the stamp of the state it is of."""

    moves: DataFrame
    deltas: DataFrame
    stamp: tuple[str, int]
    consumed: bool = False


@dataclass(frozen=True)
class Receipt:
    """What a commit replaced."""

    before: BlockState
    after: BlockState


@dataclass(frozen=True)
class BlockState:
    """A partition(id, grp, ...) of a graph with the counts that it gives: pairs(r, s, m) and totals(grp, wr, mrp, mrm).

    States don't change: a commit gives the next, of the same identity and one epoch later, whose counts come from the
    old ones and the move's deltas.
    """

    g: Graph
    partition: DataFrame
    pairs: DataFrame
    totals: DataFrame
    identity: str = field(default_factory=lambda: uuid.uuid4().hex)
    epoch: int = 0

    @classmethod
    def of(cls, g: Graph, partition: DataFrame) -> BlockState:
        pairs = B.pair_counts(g, partition)
        return cls(g, partition, pairs, B.group_totals(g, partition, pairs))

    @property
    def stamp(self) -> tuple[str, int]:
        return self.identity, self.epoch

    def group_of(self, v: int) -> int | None:
        row = self.partition.where(F.col("id") == v).select("grp").first()
        return row and row[0]

    def n_groups(self) -> int:
        """Occupied groups."""
        return self.totals.where("wr > 0").count()

    def record(self, moves: DataFrame) -> Transition:
        """The deltas of moves(move_id, id, to), one a vertex."""
        return Transition(moves, B.move_deltas(self.g, self.partition, moves), self.stamp)

    def price(self, t: Transition, params: EntropyParams = EntropyParams(), dense: bool = False) -> DataFrame:
        """(move_id, ds) of each move alone."""
        self._check(t, t.stamp == self.stamp)
        if dense:
            if params.deg_corr:
                raise ValueError("the dense entropy is not degree-corrected")
            return dense_prices(self.g, self.partition, t.moves, params.multigraph)
        return B.move_prices(self.g, self.partition, t.moves, params.deg_corr)

    def _check(self, t: Transition, good: bool) -> None:
        if t.consumed or not good:
            raise StampMismatchError(f"recorded at {t.stamp}, not at {self.stamp}" if not t.consumed else "already committed")

    def commit(self, t: Transition) -> Receipt:
        """Make the moves; both halves of the stamp must be the state's."""
        return self._committed(t, t.stamp == self.stamp)

    def commit_shared(self, t: Transition) -> Receipt:
        """Make the moves whatever was committed since they were recorded; counts are then taken anew."""
        return self._committed(t, t.stamp[0] == self.identity)

    def _committed(self, t: Transition, good: bool) -> Receipt:
        self._check(t, good)
        loop = Loop(self.g.vertices.sparkSession)
        moves = t.moves.select("id", F.col("to").alias("__to"))
        own = self.partition.join(moves, "id", "left")
        partition = loop.fixed(own.select(*[F.coalesce("__to", "grp").alias("grp") if c == "grp" else F.col(c) for c in self.partition.columns]), "partition")
        if t.stamp == self.stamp and t.moves.count() == 1:
            change = t.deltas.groupBy("r", "s").agg(F.sum("d").alias("d"))
            both = self.pairs.select("r", "s", "m").unionByName(change.select("r", "s", F.col("d").alias("m")))
            pairs = both.groupBy("r", "s").agg(F.sum("m").alias("m")).where("m <> 0")
        else:  # an edge between two that move changes by both
            pairs = B.pair_counts(self.g, partition)
        pairs = loop.fixed(pairs, "pairs")
        after = replace(self, partition=partition, pairs=pairs, totals=loop.fixed(B.group_totals(self.g, partition, pairs), "totals"), epoch=self.epoch + 1)
        t.consumed = True
        return Receipt(self, after)

    def move_prob(self, v: int, to: int) -> float:
        """The log-probability to propose the reverse of moving v to a group, when that is made; of an even proposal of occupied groups."""
        old = self.group_of(v)
        if old is None:
            return -math.inf
        totals = {r.grp: r.wr for r in self.totals.where(F.col("grp").isin(old, to)).select("grp", "wr").collect()}
        weight = 1 if "vweight" not in self.partition.columns else self.partition.where(F.col("id") == v).first()["vweight"]
        b = self.n_groups()
        if to == old:
            return -math.inf if not totals.get(old) else -math.log(b)
        if totals.get(old, 0) == weight:  # the old group would be empty, and empty groups aren't proposed
            return -math.inf
        return -math.log(b + (not totals.get(to)))

    def audit(self) -> None:
        """Counts are those of graph and partition, exactly, else an AuditError."""
        fresh = BlockState.of(self.g, self.partition)
        for name in ("pairs", "totals"):
            held, own = getattr(self, name), getattr(fresh, name)
            if not held.exceptAll(own.select(*held.columns)).isEmpty() or not own.select(*held.columns).exceptAll(held).isEmpty():
                raise AuditError(f"{name} differ")

    def audit_price(self, t: Transition, params: EntropyParams = EntropyParams(), tolerance: float = 1e-9) -> None:
        """The price of one recorded move is the difference of entropies before and after it, else an AuditError."""
        ds = self.price(t, params).agg(F.sum("ds")).first()[0]
        moved = self.partition.join(t.moves.select("id", F.col("to").alias("__to")), "id", "left")
        after = moved.select(*[F.coalesce("__to", "grp").alias("grp") if c == "grp" else F.col(c) for c in self.partition.columns])
        old, new = (B.entropy(self.g, p, params.deg_corr).first()[0] for p in (self.partition, after))
        if abs(new - old - ds) > tolerance + 1e-9 * max(abs(old), abs(new)):
            raise AuditError(f"priced at {ds}, changes by {new - old}")


def dense_entropy(g: Graph, partition: DataFrame, multigraph: bool = True) -> DataFrame:
    """One row: the entropy in the dense model, which counts the ways to place each pair's edges."""
    directed = g.direction != "undirected"
    pairs = B.pair_counts(g, partition)
    wr = B.group_totals(g, partition, pairs).select("grp", "wr")
    both = pairs.join(wr.select(F.col("grp").alias("r"), F.col("wr").alias("nr")), "r").join(wr.select(F.col("grp").alias("s"), F.col("wr").alias("ns")), "s")
    term = B.dense_pair_term(F.col("m"), F.col("nr"), F.col("ns"), F.col("r") == F.col("s"), directed, multigraph)
    return both.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("entropy"))


def dense_prices(g: Graph, partition: DataFrame, moves: DataFrame, multigraph: bool = True) -> DataFrame:
    """(move_id, ds): the change of the dense entropy by each move(move_id, id, to) alone.

    Both groups of a move change in size, so all pairs that they are in are worked out before and after it; pairs
    without edges have a term of 0. A move has as many rows as its two groups have pairs.
    """
    directed = g.direction != "undirected"
    pairs = B.pair_counts(g, partition)
    wr = B.group_totals(g, partition, pairs).select("grp", "wr")
    weight = F.col("vweight") if "vweight" in partition.columns else F.lit(1).cast("long")
    at = moves.join(partition, "id").select("move_id", F.col("grp").alias("from"), "to", weight.alias("w")).where(F.col("from") != F.col("to"))
    near = at.select("move_id", F.explode(F.array("from", "to")).alias("grp"))
    halves = pairs.select(F.col("r").alias("grp"), "r", "s").unionByName(pairs.where("r <> s").select(F.col("s").alias("grp"), "r", "s"))
    delta = B.move_deltas(g, partition, moves)
    touched = near.join(halves, "grp").select("move_id", "r", "s").unionByName(delta.select("move_id", "r", "s")).distinct()
    rows = touched.join(pairs, ["r", "s"], "left").join(delta, ["move_id", "r", "s"], "left").join(at, "move_id")
    for c in ("r", "s"):
        rows = rows.join(wr.select(F.col("grp").alias(c), F.col("wr").alias(f"n{c}")), c, "left")
    zero = F.lit(0).cast("long")
    m, d = F.coalesce("m", zero), F.coalesce("d", zero)
    n = {c: F.coalesce(f"n{c}", zero) for c in ("r", "s")}
    shift = lambda c: F.when(F.col(c) == F.col("from"), -F.col("w")).when(F.col(c) == F.col("to"), F.col("w")).otherwise(zero)

    def term(count: Column, nr: Column, ns: Column) -> Column:
        return F.when(count == 0, F.lit(0.0)).otherwise(B.dense_pair_term(count, nr, ns, F.col("r") == F.col("s"), directed, multigraph))

    ds = term(m + d, n["r"] + shift("r"), n["s"] + shift("s")) - term(m, n["r"], n["s"])
    found = rows.groupBy("move_id").agg(F.sum(ds).alias("ds"))
    return moves.select("move_id").join(found, "move_id", "left").select("move_id", F.coalesce("ds", F.lit(0.0)).alias("ds"))


def propagate(deltas: DataFrame, up: DataFrame, directed: bool = True) -> DataFrame:
    """deltas(move_id, r, s, d) on the next level of a hierarchy, whose groups are up(id, grp); zeros are left out.

    An OutOfPlaneError is raised for a group that has none there.
    """
    known = up.select("id", "grp")
    both = deltas.where("d <> 0").join(known.select(F.col("id").alias("r"), F.col("grp").alias("x")), "r", "left").join(known.select(F.col("id").alias("s"), F.col("grp").alias("y")), "s", "left")
    lost = both.where("x IS NULL OR y IS NULL").select(F.when(F.col("x").isNull(), F.col("r")).otherwise(F.col("s"))).first()
    if lost is not None:
        raise OutOfPlaneError(f"group {lost[0]} has no group on the next level")
    r, s = (F.col("x"), F.col("y")) if directed else (F.least("x", "y"), F.greatest("x", "y"))
    return both.groupBy("move_id", r.alias("r"), s.alias("s")).agg(F.sum("d").alias("d")).where("d <> 0")
