"""Directed multigraphs as a pair of DataFrames, and the views on them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.superstep import numbered


class GraphError(ValueError):
    """A vertex, edge or invariant of a graph is wrong."""


class NotDirectedError(ValueError):
    """An operation along in-edges was asked of an undirected view."""


class ShortMaskError(ValueError):
    """A mask has no value for some slot under the bound."""


class DispatchError(ValueError):
    """An operation doesn't take what it was offered: axis, offered, accepted."""

    def __init__(self, axis: str, offered: str, accepted: tuple[str, ...]):
        super().__init__(f"{axis} {offered} is not one of {', '.join(accepted)}")
        self.axis, self.offered, self.accepted = axis, offered, accepted


#: The six views: a direction, filtered or not.
VIEWS = ("directed", "reversed", "undirected", "filtered directed", "filtered reversed", "filtered undirected")


@dataclass(frozen=True)
class Graph:
    """vertices(id, ...) and edges(edge_id, src, dst, ...): loops and parallel edges are edges of their own.

    direction is directed, reversed or undirected and says how incidences are read; the edges' storage stays as it is,
    but for reversed, which swaps their ends. vertex_bound and edge_bound are one more than the highest id there ever
    was, for outputs with a row for every slot. released holds the ids of removed edges, (at, edge_id) with n_released
    rows from 0 on, a stack: the last are given out anew first.
    """

    vertices: DataFrame
    edges: DataFrame
    vertex_bound: int
    edge_bound: int
    direction: str = "directed"
    released: DataFrame | None = None
    n_released: int = 0
    identity: str = field(default_factory=lambda: uuid.uuid4().hex)
    #: Of a view with filtered vertices, the edges that it has but for that their ends may be filtered out: from such a
    #: source a traversal may start. Every change of edges is one of these too.
    entries: DataFrame | None = None

    # ---- construction

    @classmethod
    def empty(cls, spark: SparkSession, n: int = 0) -> Graph:
        """n isolated vertices."""
        return cls(spark.range(n).select(F.col("id")), spark.createDataFrame([], "edge_id long, src long, dst long"), n, 0)

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, order_by: list | None = None) -> Graph:
        """A graph of edges(src, dst, ...); edge ids by order_by if there is no edge_id. Vertices default to the ends."""
        if "edge_id" not in edges.columns:
            edges = numbered(edges, order_by or ["src", "dst"], "edge_id")
        rest = [c for c in edges.columns if c not in ("edge_id", "src", "dst")]
        edges = edges.select(*[F.col(c).cast("long").alias(c) for c in ("edge_id", "src", "dst")], *rest)
        if vertices is None:
            vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        n = vertices.agg(F.max("id")).first()[0]
        m = edges.agg(F.max("edge_id")).first()[0]
        return cls(vertices, edges, 0 if n is None else n + 1, 0 if m is None else m + 1)

    # ---- views

    def undirected(self) -> Graph:
        """Incidences both ways; absorbs reversed()."""
        base = self if self.direction != "reversed" else self.reversed()
        return replace(base, direction="undirected")

    def reversed(self) -> Graph:
        """Out-edges become in-edges; twice is once more the graph itself."""
        if self.direction == "undirected":
            raise NotDirectedError("an undirected view has no reverse")
        turned = [F.col("dst").alias("src") if c == "src" else F.col("src").alias("dst") if c == "dst" else F.col(c) for c in self.edges.columns]
        entries = None if self.entries is None else self.entries.select(*turned)
        return replace(self, edges=self.edges.select(*turned), entries=entries, direction="directed" if self.direction == "reversed" else "reversed")

    def filtered(self, vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """Vertices and edges for which the predicates hold, without edges that lose an end. Bounds stay."""
        out = self if edge is None else self._changed(lambda e: e.where(edge))
        if vertex is None:
            return out
        every = out.edges if out.entries is None else out.entries
        return replace(out, vertices=out.vertices.where(vertex), entries=every)._settled()

    def masked(self, vmask: DataFrame, emask: DataFrame) -> Graph:
        """The view of vertices and edges whose mask is neither 0 nor false; masks are (id, keep) and (edge_id, keep).

        A mask has a row for every slot under the bound, else a ShortMaskError is raised.
        """
        for mask, key, bound in ((vmask, "id", self.vertex_bound), (emask, "edge_id", self.edge_bound)):
            if mask.where((F.col(key) >= 0) & (F.col(key) < bound)).select(key).distinct().count() < bound:
                raise ShortMaskError(f"the mask of {key} has fewer than {bound} slots")
        kept = {key: mask.where(F.coalesce(F.col("keep").cast("boolean"), F.lit(False))).select(key).distinct() for mask, key in ((vmask, "id"), (emask, "edge_id"))}
        out = self._changed(lambda e: e.join(kept["edge_id"], "edge_id", "left_semi").select(*e.columns))
        every = out.edges if out.entries is None else out.entries
        return replace(out, vertices=out.vertices.join(kept["id"], "id", "left_semi"), entries=every)._settled()

    def _changed(self, change) -> Graph:
        """With a change of the edges, of those that a filter hides too."""
        return replace(self, edges=change(self.edges), entries=None if self.entries is None else change(self.entries))

    def _settled(self) -> Graph:
        """With the edges that are among entries and have both ends."""
        ids = self.vertices.select("id")
        both = self.entries.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        return replace(self, edges=both.select(*self.entries.columns))

    @property
    def view(self) -> str:
        """Which of VIEWS this is."""
        return self.direction if self.entries is None else f"filtered {self.direction}"

    def dispatch(self, kernel, accepted: tuple[str, ...] = VIEWS):
        """What kernel, a callable, makes of this view; a DispatchError if it isn't one of those accepted."""
        if self.view not in accepted:
            raise DispatchError("view", self.view, accepted)
        return kernel(self)

    def dispatch_bidi(self, kernel):
        """As dispatch, for kernels that need in-edges: a NotDirectedError on undirected views."""
        if self.direction == "undirected":
            raise NotDirectedError(f"{self.view} is not one of {', '.join(v for v in VIEWS if 'undirected' not in v)}")
        return kernel(self)

    # ---- scans

    def out(self, edges: DataFrame | None = None) -> DataFrame:
        """Incidences (v, other, edge_id, ...) along out-edges; all of them if undirected."""
        edges = self.edges if edges is None else edges
        rest = [c for c in edges.columns if c not in ("src", "dst")]
        ahead = edges.select(F.col("src").alias("v"), F.col("dst").alias("other"), *rest)
        if self.direction != "undirected":
            return ahead
        return ahead.unionByName(edges.select(F.col("dst").alias("v"), F.col("src").alias("other"), *rest))

    def into(self) -> DataFrame:
        """Incidences against in-edges, of directed views only."""
        if self.direction == "undirected":
            raise NotDirectedError("an undirected view has no in-edges")
        return self.edges.select(F.col("dst").alias("v"), F.col("src").alias("other"), *[c for c in self.edges.columns if c not in ("src", "dst")])

    def incidence(self) -> DataFrame:
        """Both halves of every edge; a loop comes twice."""
        return replace(self, direction="undirected").out()

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def anchored(self) -> DataFrame:
        """Incidences along out-edges whose far end is in the view; the anchor may be filtered out, and start a traversal."""
        if self.entries is None:
            return self.out()
        return self.out(self.entries).join(self.vertices.select(F.col("id").alias("other")), "other", "left_semi")

    def block(self, v: int) -> DataFrame:
        """The incidences of one vertex, (half, other, edge_id): its out-half and then its in-half; a loop is in both."""
        ahead = self.edges.where(F.col("src") == v).select(F.lit("out").alias("half"), F.col("dst").alias("other"), "edge_id")
        return ahead.unionByName(self.edges.where(F.col("dst") == v).select(F.lit("in").alias("half"), F.col("src").alias("other"), "edge_id"))

    def endpoints(self, ids: DataFrame) -> DataFrame:
        """(edge_id, src, dst) for the rows of ids(edge_id); nulls where the view has no such edge."""
        return ids.select("edge_id").join(self.edges.select("edge_id", "src", "dst"), "edge_id", "left")

    def opposite(self, pairs: DataFrame) -> DataFrame:
        """(edge_id, v, other) for the rows of pairs(edge_id, v): the end that isn't v, of a loop v itself; null if v is no end."""
        found = pairs.select("edge_id", "v").join(self.edges.select("edge_id", "src", "dst"), "edge_id", "left")
        return found.select("edge_id", "v", opposite(F.col("src"), F.col("dst"), F.col("v")).alias("other"))

    def find_edges(self) -> DataFrame:
        """(src, dst, edge_id): the oldest edge of each ordered pair.

        Of undirected views (s, t, edge_id, src, dst) for each pair of ends in both orders: the oldest stored from s to
        t, or where there is none from t to s, with its ends as they are stored.
        """
        oldest = self.edges.groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))
        if self.direction != "undirected":
            return oldest
        ahead = oldest.select(F.col("src").alias("s"), F.col("dst").alias("t"), F.lit(0).alias("turn"), "edge_id", "src", "dst")
        back = oldest.where("src <> dst").select(F.col("dst").alias("s"), F.col("src").alias("t"), F.lit(1).alias("turn"), "edge_id", "src", "dst")
        first = ahead.unionByName(back).groupBy("s", "t").agg(F.min(F.struct("turn", "edge_id", "src", "dst")).alias("e"))
        return first.select("s", "t", "e.edge_id", "e.src", "e.dst")

    def slots(self) -> DataFrame:
        """id of every vertex slot under the bound."""
        return self.vertices.sparkSession.range(self.vertex_bound).select("id")

    def densify(self, values: DataFrame, column: str, unset) -> DataFrame:
        """(id, column) of every slot; unset where values has none."""
        return self.slots().join(values.select("id", column), "id", "left").select("id", F.coalesce(F.col(column), F.lit(unset)).alias(column))

    # ---- mutation; each gives a new graph

    def add_vertices(self, k: int = 1) -> Graph:
        new = self.vertices.sparkSession.range(self.vertex_bound, self.vertex_bound + k).select("id")
        return replace(self, vertices=self.vertices.unionByName(new, allowMissingColumns=True), vertex_bound=self.vertex_bound + k)

    def add_edges(self, pairs: DataFrame, order_by: list | None = None) -> Graph:
        """Edges for the rows of pairs(src, dst, ...) in that order: released ids, last first, then new ones."""
        ids = self.vertices.select("id")
        bad = pairs.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_anti")
        if not bad.isEmpty():
            raise GraphError("an end of a new edge is no vertex")
        new, n = numbered(pairs, order_by or ["src", "dst"], "__k"), pairs.count()
        fresh = F.col("__k") + F.lit(self.edge_bound - self.n_released)
        if self.n_released:
            again = self.released.select((F.lit(self.n_released - 1) - F.col("at")).alias("__k"), F.col("edge_id").alias("__again"))
            new = new.join(again, "__k", "left")
            fresh = F.coalesce("__again", fresh)
        new = new.withColumn("edge_id", fresh.cast("long")).drop("__k", "__again")
        left = max(0, self.n_released - n)
        out = self._changed(lambda e: e.unionByName(new, allowMissingColumns=True))
        return replace(out, released=self.released.where(F.col("at") < left) if left else None, n_released=left, edge_bound=self.edge_bound + max(0, n - self.n_released))

    def _removed(self, gone: DataFrame, n: int) -> Graph:
        """Without the edges of gone(at, edge_id), n rows from 0 on, released in that order."""
        out = self._changed(lambda e: e.join(gone.select("edge_id"), "edge_id", "left_anti").select(*e.columns))
        new = gone.select((F.col("at") + F.lit(self.n_released)).alias("at"), "edge_id")
        return replace(out, released=new if self.released is None else self.released.unionByName(new), n_released=self.n_released + n)

    def remove_edges(self, ids: list[int] | DataFrame) -> Graph:
        """Without these edges; their ids are released, those of a list in its order, those of a frame(edge_id) ascending."""
        spark = self.vertices.sparkSession
        if isinstance(ids, DataFrame):
            gone = numbered(ids.select(F.col("edge_id").cast("long").alias("edge_id")).distinct(), ["edge_id"], "at")
        else:
            gone = spark.createDataFrame([(k, int(e)) for k, e in enumerate(dict.fromkeys(ids))], "at long, edge_id long")
        n, every = gone.count(), self.edges if self.entries is None else self.entries
        if every.join(gone.select("edge_id"), "edge_id", "left_semi").count() != n:
            raise GraphError("no such edge")
        return self._removed(gone, n)

    def clear_vertices(self, ids: list[int] | DataFrame, where: Column | None = None) -> Graph:
        """Without the edges at these vertices, or those of them for which `where` holds.

        where may use the edges' columns, v, the vertex that is cleared, and other, the edge's other end. Vertices are
        cleared in ascending order, and of each the edges of its out-half are released first, both by id.
        """
        spark = self.vertices.sparkSession
        at = ids.select(F.col("id").cast("long").alias("v")).distinct() if isinstance(ids, DataFrame) else spark.createDataFrame([(int(v),) for v in ids], "v long").distinct()
        if not at.join(self.vertices.select(F.col("id").alias("v")), "v", "left_anti").isEmpty():
            raise GraphError("no such vertex")
        every = self.edges if self.entries is None else self.entries
        halves = every.select("*", F.col("src").alias("v"), F.col("dst").alias("other"), F.lit(0).alias("half")).unionByName(every.where("src <> dst").select("*", F.col("dst").alias("v"), F.col("src").alias("other"), F.lit(1).alias("half")))
        hit = halves.join(at, "v")
        hit = hit if where is None else hit.where(where)
        first = hit.groupBy("edge_id").agg(F.min(F.struct("v", "half")).alias("first"))
        gone = numbered(first, ["first", "edge_id"], "at").select("at", "edge_id")
        return self._removed(gone, gone.count())

    def swap_remove_vertex(self, v: int) -> Graph:
        """Without v and its edges, whose ids are released; the last vertex takes its id, and edges keep theirs."""
        last = self.vertex_bound - 1
        g = self.clear_vertices([v])
        end = lambda c: F.when(F.col(c) == last, F.lit(v)).otherwise(F.col(c)).cast("long").alias(c)
        g = g._changed(lambda e: e.select(*[end(c) if c in ("src", "dst") else c for c in e.columns]))
        others = g.vertices.where(F.col("id") != v).select(*[end(c) if c == "id" else F.col(c) for c in g.vertices.columns])
        return replace(g, vertices=others, vertex_bound=last)

    def compact_edges(self) -> Graph:
        """Edge ids from 0 on without gaps, in the order they have; of a filtered view those that it hides get ids too."""
        every = self.edges if self.entries is None else self.entries
        again = numbered(every.select("edge_id"), ["edge_id"], "__new")
        out = self._changed(lambda e: e.join(again, "edge_id").drop("edge_id").withColumnRenamed("__new", "edge_id").select(*e.columns))
        return replace(out, edge_bound=every.count(), released=None, n_released=0)

    def validate(self) -> None:
        """Edge ids are single and under the bound, ends are vertices."""
        if not self.edges.groupBy("edge_id").count().where("count > 1").isEmpty():
            raise GraphError("an edge id occurs twice")
        if not self.edges.where((F.col("edge_id") < 0) | (F.col("edge_id") >= self.edge_bound)).isEmpty():
            raise GraphError("an edge id is out of bounds")
        if not self.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(self.vertices, "id", "left_anti").isEmpty():
            raise GraphError("an edge ends at no vertex")


def opposite(src: Column, dst: Column, v: Column) -> Column:
    """The end of an edge that isn't v, of a loop v itself; null if v is no end."""
    return F.when(src == v, dst).when(dst == v, src)


def reversed_edge(src: Column, dst: Column) -> tuple[Column, Column]:
    """The ends of an edge, the other way round."""
    return dst, src


def anchored_at(src: Column, dst: Column, v: Column) -> tuple[Column, Column]:
    """The ends of an edge, turned so that v is the first; nulls if v is no end."""
    other = opposite(src, dst, v)
    return F.when(other.isNotNull(), v), other
