"""Property maps of vertices and edges, and a graph that is built up step by step with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.casts import ConversionError, Kind, convertible
from .graph import Graph, GraphError
from .plans.superstep import Loop

#: Values that a map keeps in the driver before they are written.
PENDING = 10_000


def value_types() -> list[str]:
    """The names of all value kinds."""
    return [k.label for k in Kind]


class WrongGraphError(ValueError):
    """A property map of another graph."""


class UndersizedError(ValueError):
    """A property map has fewer slots than the graph."""


def checked(kind: Kind, value):
    """A Python value as the kind holds it; integers must fit."""
    if kind is Kind.OBJECT:
        return value
    if kind.element:
        if isinstance(value, str | bytes) or not hasattr(value, "__iter__"):
            raise ConversionError(f"{value!r} is no {kind.label}")
        return [checked(kind.element, v) for v in value]
    if kind is Kind.STRING and isinstance(value, str):
        return value
    if kind is Kind.DOUBLE and isinstance(value, int | float):
        return float(value)
    if kind is Kind.LONG_DOUBLE and isinstance(value, bytes) and len(value) == 16:
        return value
    if kind.is_integer and isinstance(value, int):
        low, high = (0, 255) if kind is Kind.BOOL else (-(1 << kind.bits - 1), (1 << kind.bits - 1) - 1)
        if low <= int(value) <= high:
            return int(value)
    raise ConversionError(f"{value!r} is no {kind.label}")


def zero_of(kind: Kind):
    """What an unset slot reads as."""
    if kind is Kind.OBJECT:
        return None
    return [] if kind.element else 0 if kind.is_integer else {Kind.DOUBLE: 0.0, Kind.STRING: "", Kind.LONG_DOUBLE: bytes(16)}[kind]


class PropertyMap:
    """A value of one kind for every vertex ("v") or edge ("e") slot: a table (id, value) in the shared folder.

    Slots under the bound that were never set read as zero; other keys raise IndexError. A value that is none of the kind
    raises ConversionError and changes nothing. Single values are kept in the driver, PENDING at most, until they are
    written in one go; whole columns go by frame() and put().
    """

    def __init__(self, graph: GraphBuilder, kind: Kind, key_type: str):
        self.graph, self.kind, self.key_type = graph, kind, key_type
        self._pending: dict[int, object] = {}
        self._table: DataFrame | None = None
        self._loop = Loop(graph.spark)

    @property
    def value_type(self) -> str:
        return self.kind.label

    @property
    def bound(self) -> int:
        return self.graph.vertex_bound if self.key_type == "v" else self.graph.edge_bound

    @property
    def allocated(self) -> int:
        """One more than the highest slot that was set."""
        most = max(self._pending, default=-1)
        if self._table is not None:
            most = max(most, (lambda m: -1 if m is None else m)(self._table.agg(F.max("id")).first()[0]))
        return most + 1

    def _slot(self, key) -> int:
        key = int(key)
        if not 0 <= key < self.bound:
            raise IndexError(f"no slot {key} under {self.bound}")
        return key

    def __getitem__(self, key):
        key = self._slot(key)
        if key in self._pending:
            return self._pending[key]
        row = None if self._table is None else self._table.where(F.col("id") == key).select("value").first()
        if row is None or row[0] is None:
            return zero_of(self.kind)
        return bytes(row[0]) if isinstance(row[0], bytearray) else row[0]

    def __setitem__(self, key, value) -> None:
        key, value = self._slot(key), checked(self.kind, value)
        self._pending[key] = value
        if len(self._pending) >= PENDING:
            self.flush()

    def flush(self) -> None:
        """Write what is kept in the driver."""
        if self._pending:
            self.put(self.graph.spark.createDataFrame(list(self._pending.items()), f"id long, value {self.kind.spark}"), pending=True)

    def put(self, values: DataFrame, pending: bool = False) -> None:
        """Set the slots of values(id, value)."""
        if not pending:
            self.flush()
            if not values.where((F.col("id") < 0) | (F.col("id") >= self.bound)).isEmpty():
                raise IndexError(f"a slot is not under {self.bound}")
        new = values.select(F.col("id").cast("long").alias("id"), F.col("value").cast(self.kind.spark).alias("value"))
        if self._table is not None:
            new = new.unionByName(self._table.join(new.select("id"), "id", "left_anti"))
        self._table = self._loop.step(new)
        self._pending = {}

    def frame(self) -> DataFrame:
        """(id, value) of every slot under the bound; zero where unset."""
        self.flush()
        slots = self.graph.spark.range(self.bound).select("id")
        zero = zero_of(self.kind)
        if self._table is None:
            table = self.graph.spark.createDataFrame([], f"id long, value {self.kind.spark}")
        else:
            table = self._table
        fill = F.lit(None) if zero is None else F.array() if zero == [] else F.lit(zero)
        return slots.join(table, "id", "left").select("id", F.coalesce("value", fill.cast(self.kind.spark)).alias("value"))

    def view(self) -> DataFrame:
        """The slots that are there, (id, value); an UndersizedError if they are fewer than the bound."""
        if self.allocated < self.bound:
            raise UndersizedError(f"{self.allocated} slots of {self.bound}")
        return self.frame()


class ObjectPropertyMap(PropertyMap):
    """A map of Python objects, in the driver: unset slots are None."""

    def __init__(self, graph: GraphBuilder, key_type: str):
        super().__init__(graph, Kind.OBJECT, key_type)
        self._objects: dict[int, object] = {}

    @property
    def allocated(self) -> int:
        return max(self._objects, default=-1) + 1

    def __getitem__(self, key):
        return self._objects.get(self._slot(key))

    def __setitem__(self, key, value) -> None:
        self._objects[self._slot(key)] = value

    def map_values(self, f: Callable) -> None:
        """Replace the object of every slot by f of it, in order of slot; if f fails nothing changes."""
        self._objects = {k: f(self._objects.get(k)) for k in range(self.bound)}

    def frame(self) -> DataFrame:
        raise ConversionError("objects are in the driver only")


class GraphBuilder:
    """A directed multigraph that grows and shrinks edge by edge, with property maps; graph() has its frames.

    What is added one by one is kept in the driver, for graphs built by hand; a large graph starts from frames.
    """

    def __init__(self, spark: SparkSession, start: Graph | None = None):
        self.spark = spark
        self._graph = start or Graph.empty(spark)
        self._vertices = 0
        self._edges: list[tuple[int, int]] = []

    def graph(self) -> Graph:
        """The graph as it is."""
        g = self._graph
        if self._vertices:
            g, self._vertices = g.add_vertices(self._vertices), 0
        if self._edges:
            rows = [(k, a, b) for k, (a, b) in enumerate(self._edges)]
            g = g.add_edges(self.spark.createDataFrame(rows, "order long, src long, dst long"), ["order"])
            g = g._changed(lambda e: e.drop("order"))
            self._edges = []
        self._graph = g
        return g

    @property
    def vertex_bound(self) -> int:
        return self._graph.vertex_bound + self._vertices

    @property
    def edge_bound(self) -> int:
        return self.edge_index_range()

    def num_vertices(self) -> int:
        return self._graph.num_vertices() + self._vertices

    def num_edges(self) -> int:
        return self._graph.num_edges() + len(self._edges)

    def edge_index_range(self) -> int:
        """One more than the highest edge id there is room for."""
        return self._graph.edge_bound + max(0, len(self._edges) - self._graph.n_released)

    def add_vertex(self) -> int:
        self._vertices += 1
        return self.vertex_bound - 1

    def add_edge(self, a: int, b: int) -> int:
        """The new edge's id."""
        for v in (a, b):
            if not 0 <= v < self.vertex_bound:
                raise GraphError(f"no vertex {v}")
        g, k = self._graph, len(self._edges)
        new = g.edge_bound + k - g.n_released
        if k < g.n_released:
            new = g.released.where(F.col("at") == g.n_released - 1 - k).first()["edge_id"]
        self._edges.append((int(a), int(b)))
        return new

    def remove_edge(self, e: int) -> None:
        self._graph = self.graph().remove_edges([e])

    def new_vertex_property(self, kind: str) -> PropertyMap:
        return self._map(kind, "v")

    def new_edge_property(self, kind: str) -> PropertyMap:
        return self._map(kind, "e")

    def _map(self, kind: str, key_type: str) -> PropertyMap:
        k = Kind.of(kind)
        return ObjectPropertyMap(self, key_type) if k is Kind.OBJECT else PropertyMap(self, k, key_type)

    def sum_property(self, values: PropertyMap) -> float:
        """The sum of a map of numbers over all slots."""
        if values.graph is not self:
            raise WrongGraphError("the map is another graph's")
        if not (values.kind.is_scalar and convertible(values.kind, Kind.DOUBLE)):
            raise ConversionError(f"{values.value_type} is no number")
        return values.frame().agg(F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0))).first()[0]
