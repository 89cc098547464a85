"""Property maps, views, reductions and block-model states on small graphs, with what they refuse."""

import math

import pytest
from pyspark.sql import functions as F

from sparkweave import properties
from sparkweave.functions.casts import ConversionError, DynWrap, Kind, convert, copy_prop
from sparkweave.graph import VIEWS, DispatchError, Graph, GraphError, NotDirectedError, ShortMaskError
from sparkweave.operators import blockstate, reduce, traversal


def graph(spark, n, edges):
    rows = [(i, a, b, 1.0) for i, (a, b) in enumerate(edges)]
    return Graph(spark.range(n).select("id"), spark.createDataFrame(rows, "edge_id long, src long, dst long, weight double"), n, len(edges))


def test_a_graph_is_built_edge_by_edge(spark):
    g = properties.GraphBuilder(spark)
    assert [g.add_vertex() for _ in range(4)] == [0, 1, 2, 3]
    assert [g.add_edge(0, 1), g.add_edge(1, 2), g.add_edge(2, 3)] == [0, 1, 2]
    g.remove_edge(1)
    assert (g.num_edges(), g.edge_index_range()) == (2, 3) and [g.add_edge(3, 0), g.add_edge(3, 1)] == [1, 3]
    assert sorted(map(tuple, g.graph().edges.select("edge_id", "src", "dst").collect())) == [(0, 0, 1), (1, 3, 0), (2, 2, 3), (3, 3, 1)]
    with pytest.raises(GraphError):
        g.add_edge(0, 9)


def test_property_maps(spark):
    g = properties.GraphBuilder(spark, graph(spark, 3, [(0, 1)]))
    m = g.new_vertex_property("int16_t")
    assert (m.value_type, m.key_type, m.allocated, m[2]) == ("int16_t", "v", 0, 0)
    m[1] = 7
    for bad in (70_000, "x", 1.5):
        with pytest.raises(ConversionError):
            m[1] = bad
    with pytest.raises(IndexError):
        m[3]
    with pytest.raises(properties.UndersizedError):
        m.view()
    m.flush()
    m[2] = -1
    assert m[1] == 7 and [r.value for r in m.frame().orderBy("id").collect()] == [0, 7, -1] and m.view().count() == 3
    assert g.sum_property(m) == 6.0
    with pytest.raises(properties.WrongGraphError):
        properties.GraphBuilder(spark).sum_property(m)
    with pytest.raises(ConversionError):
        g.sum_property(g.new_edge_property("string"))
    o = g.new_edge_property("python::object")
    o[0] = {"a": 1}
    o.map_values(lambda x: (x or {}) | {"b": 2})
    assert o[0] == {"a": 1, "b": 2} and len(properties.value_types()) == 15
    vectors = g.new_vertex_property("vector<double>")
    vectors[0] = [1, 2.5]
    assert vectors[0] == [1.0, 2.5] and vectors[2] == []


def test_copies_and_wraps(spark):
    df = spark.createDataFrame([(0, "1"), (1, "x"), (2, "y"), (3, None)], "id long, s string")
    with pytest.raises(ConversionError, match="id 1:"):
        copy_prop(df, "id", "s", Kind.STRING, "n", Kind.INT32)
    read = DynWrap("s", Kind.STRING, Kind.INT32, write=False)
    assert [r[0] for r in df.orderBy("id").select(read.get()).collect()] == [1, None, None, None]
    with pytest.raises(ConversionError):
        read.put(df, F.lit(1))
    with pytest.raises(ConversionError):
        DynWrap("s", Kind.STRING, Kind.VECTOR_INT32)


@pytest.mark.parametrize(("x", "text"), [(1e20, "100000000000000000000"), (1e-5, "0.00001"), (-0.0, "-0"), (0.0, "0"), (0.1, "0.1"), (-1234.5, "-1234.5"), (1e7, "10000000"), (12345678.25, "12345678.25"), (math.inf, "inf"), (-math.inf, "-inf"), (math.nan, "nan"), (2e-3, "0.002"), (8.642e21, "8642000000000000000000"), (1.7976931348623157e308, "17976931348623157" + "0" * 292)])
def test_doubles_print_without_exponents(spark, x, text):
    assert spark.createDataFrame([(x,)], "x double").select(convert(F.col("x"), Kind.DOUBLE, Kind.STRING)).first()[0] == text


def test_text_that_is_no_number(spark):
    df = spark.createDataFrame([("5\n", ["1", "x"])], "s string, v array<string>")
    assert tuple(df.select(convert(F.col("s"), Kind.STRING, Kind.INT64), convert(F.col("s"), Kind.STRING, Kind.DOUBLE), convert(F.col("v"), Kind.VECTOR_STRING, Kind.VECTOR_INT64)).first()) == (None, None, None)


def test_filtered_views_stay_right_after_changes(spark):
    path = graph(spark, 4, [(0, 1), (1, 2), (2, 3)])
    f = path.filtered(F.col("id") < 9)
    for cut in (f.filtered(edge=F.col("src") != 1), f.remove_edges([1]), f.clear_vertices([1], F.col("other") == 2)):
        assert {tuple(r) for r in traversal.bfs(cut, [0]).collect()} == {(0, 0), (1, 1)}
    hidden = path.filtered(F.col("id") != 0)
    assert {tuple(r) for r in traversal.bfs(hidden, [0]).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    inf = math.inf
    assert [r.distance for r in traversal.dijkstra(hidden, 0, "weight").orderBy("id").collect()] == [inf, 1, 2, 3]
    assert [r.distance for r in traversal.dijkstra(hidden, 0).orderBy("id").collect()] == [inf, 1, 2, 3]
    assert sorted(r.edge_id for r in hidden.compact_edges().edges.collect()) == [1, 2]


def test_masks_and_dispatch(spark):
    g = graph(spark, 3, [(0, 1), (1, 2)])
    ones = lambda n, key: spark.range(n).select(F.col("id").alias(key), F.lit(1).alias("keep"))
    with pytest.raises(ShortMaskError):
        g.masked(ones(2, "id"), ones(2, "edge_id"))
    m = g.masked(ones(3, "id").where("true"), ones(2, "edge_id").withColumn("keep", F.col("edge_id")))
    assert [tuple(r) for r in m.edges.select("edge_id", "src", "dst").collect()] == [(1, 1, 2)]
    views = [v for x in (g, m) for v in (x, x.reversed(), x.undirected())]
    assert [v.dispatch(lambda x: x.view) for v in views] == list(VIEWS)
    with pytest.raises(DispatchError) as e:
        g.undirected().dispatch(lambda x: x, ("directed",))
    assert (e.value.axis, e.value.offered, e.value.accepted) == ("view", "undirected", ("directed",))
    with pytest.raises(NotDirectedError):
        g.undirected().dispatch_bidi(lambda x: x)
    assert m.dispatch_bidi(lambda x: x.num_edges()) == 1


def test_depth_first_on_views(spark):
    g = graph(spark, 4, [(0, 1), (0, 2), (1, 3), (2, 3)])
    order = lambda view, *a, **k: [(r.id, r.depth) for r in traversal.depth_first(view, *a, **k).orderBy("order").collect()]
    assert order(g, 0) == [(0, 0), (1, 1), (3, 2), (2, 1)]
    assert order(g.filtered(F.col("id") != 1), 0) == [(0, 0), (2, 1), (3, 2)]
    assert order(g, 0, lambda v, d: "stop" if v == 3 else None) == [(0, 0), (1, 1), (3, 2)]


def test_plans_and_reductions(spark):
    for n, grain in ((0, 3), (1, 3), (10, 3), (11, 4), (100, 7)):
        plan = reduce.Plan(n, grain)
        assert [i for k in range(plan.chunks) for i in plan.range(k)] == list(range(n))
        found = {r.i: r.k for r in spark.range(n).select(F.col("id").alias("i"), plan.chunk_of(F.col("id")).alias("k")).collect()}
        assert found == {i: k for k in range(plan.chunks) for i in plan.range(k)}
    df = spark.range(10).select("id", (F.col("id") * 0.1).alias("x"))
    total = lambda v, s: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    check = lambda v: F.when(F.exists(v, lambda x: x > 0.45), F.concat(F.lit("too much: "), F.size(v).cast("string")))
    with pytest.raises(reduce.ReduceError) as e:
        reduce.try_det_reduce(df, reduce.Plan(10, 2), "id", "x", total, check, F.lit(0.0), lambda a, x: a + x)
    assert e.value.chunk == 2
    sum_of = spark.range(1).select(reduce.chunked_sum(F.array(*[F.lit(float(x)) for x in range(9)]), 4).alias("s"))
    assert sum_of.first().s == 36.0


def test_block_states(spark):
    g = graph(spark, 5, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 4), (0, 3)])
    state = blockstate.BlockState.of(g, spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)], "id long, grp long"))
    move = lambda *rows: spark.createDataFrame([(k, v, to) for k, (v, to) in enumerate(rows)], "move_id long, id long, to long")
    t = state.record(move((2, 0)))
    state.audit_price(t)
    new = state.commit(t).after
    new.audit()
    assert new.epoch == 1 and new.group_of(2) == 0 and new.n_groups() == 3
    for stale in (t, state.record(move((1, 1)))):
        with pytest.raises(blockstate.StampMismatchError):
            new.commit(stale)
    shared = new.commit_shared(state.record(move((1, 1), (3, 2)))).after
    shared.audit()
    with pytest.raises(blockstate.AuditError):
        blockstate.replace(new, pairs=new.pairs.withColumn("m", F.col("m") + 1)).audit()
    with pytest.raises(ValueError, match="degree"):
        state.price(state.record(move((2, 0))), dense=True)
    assert state.move_prob(4, 0) == -math.inf and state.move_prob(0, 1) == pytest.approx(-math.log(3)) and state.move_prob(0, 9) == pytest.approx(-math.log(4))
    for view in (g, g.undirected()):
        for multigraph in (True, False):
            own = blockstate.BlockState.of(view, state.partition)
            ds = {r.move_id: r.ds for r in own.price(own.record(move((2, 0), (4, 1))), blockstate.EntropyParams(False, multigraph), dense=True).collect()}
            h = lambda s: blockstate.dense_entropy(s.g, s.partition, multigraph).first()[0]  # noqa: E731, B023
            for k, m in enumerate(((2, 0), (4, 1))):
                after = own.commit(own.record(move(m))).after
                assert ds[k] == pytest.approx(h(after) - h(own), abs=1e-9)
    with pytest.raises(blockstate.OutOfPlaneError):
        blockstate.propagate(state.record(move((2, 0))).deltas, spark.createDataFrame([(0, 0)], "id long, grp long"))
    turns = lambda s: [r.id for r in s.turns(g.vertices, 1, 0).orderBy("turn").collect()]
    assert turns(blockstate.Schedule.ALTERNATING) == [0, 1, 2, 3, 4] and sorted(turns(blockstate.Schedule.SHUFFLED)) == [0, 1, 2, 3, 4] and len(turns(blockstate.Schedule.RANDOM)) == 5
