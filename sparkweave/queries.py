"""The graph queries of the driver contract and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import datasets as D
from . import properties
from .functions.casts import DynWrap, Kind, convert, copied, copy_prop
from .functions.special import lbinom, lgamma1p, safelog, xlogx
from .graph import Graph, anchored_at, reversed_edge
from .operators import blockmodel as B
from .operators import blockstate as S
from .operators import centrality as C
from .operators import components as K
from .operators import degree as G
from .operators import reduce as R
from .operators import topology as T
from .operators import traversal as V
from .plans.superstep import shared_dir
from .sources import binary, dot, edgelist, graphml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEQ = """e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS edge_id, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, value AS weight FROM events QUALIFY dst IS NOT NULL),
v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), bound AS (SELECT max(id) + 1 AS n FROM v), slots AS (SELECT unnest(range(n)) AS id FROM bound)"""
PART = "e AS MATERIALIZED (SELECT l_orderkey * 8 + l_linenumber AS edge_id, l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst, l_quantity AS weight FROM lineitem), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"
GEO = "e AS MATERIALIZED (SELECT n_regionkey * 4 AS src, n_nationkey * 4 + 1 AS dst FROM nation UNION ALL SELECT c_nationkey * 4 + 1, c_custkey * 4 + 2 FROM customer UNION ALL SELECT s_nationkey * 4 + 1, s_suppkey * 4 + 3 FROM supplier), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


HISTOGRAM = "d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), h AS (SELECT degree, count(*) AS n FROM d GROUP BY degree) SELECT x.degree, coalesce(n, 0) AS count FROM (SELECT unnest(range(max(degree) + 1)) AS degree FROM h) x LEFT JOIN h ON h.degree = x.degree"


@query(f"WITH {SEQ}, {HISTOGRAM}")
def degree_histogram(spark, sf_dir):
    return G.degree_histogram(D.user_seq(spark, sf_dir).undirected())


@query(f"WITH {PART}, {HISTOGRAM}")
def degree_histogram_bipartite(spark, sf_dir):
    return G.degree_histogram(D.supp_part(spark, sf_dir))


@query(f"""WITH {SEQ}, o AS (SELECT src AS id, count(*) AS n, sum(weight) AS w FROM e GROUP BY src), i AS (SELECT dst AS id, count(*) AS n, sum(weight) AS w FROM e GROUP BY dst)
SELECT v.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree, round(coalesce(o.w, 0.0), 4) AS weighted_out_degree, round(coalesce(i.w, 0.0), 4) AS weighted_in_degree, round(coalesce(o.w, 0.0) + coalesce(i.w, 0.0), 4) AS weighted_degree FROM v LEFT JOIN o ON o.id = v.id LEFT JOIN i ON i.id = v.id""")
def degrees(spark, sf_dir):
    return rounded(G.degrees(D.user_seq(spark, sf_dir), "weight"), "weighted_out_degree", "weighted_in_degree", "weighted_degree", digits=4)


@query(f"WITH {PART} SELECT v.id, count(e.edge_id) AS degree, count(e.edge_id) * 2.5 AS weighted_degree FROM v LEFT JOIN e ON e.src = v.id OR e.dst = v.id GROUP BY v.id")
def degrees_constant_weight(spark, sf_dir):
    return G.degrees(D.supp_part(spark, sf_dir).undirected(), 2.5)


@query(f"WITH {SEQ} SELECT slots.id, count(e.src) AS out_degree FROM slots LEFT JOIN e ON e.src = slots.id GROUP BY slots.id")
def out_degrees(spark, sf_dir):
    return G.out_degrees(D.user_seq(spark, sf_dir))


@query(f"WITH {SEQ} SELECT slots.id, count(e.src) AS out_degree FROM slots LEFT JOIN e ON e.dst = slots.id GROUP BY slots.id")
def out_degrees_reversed(spark, sf_dir):
    return G.out_degrees(D.user_seq(spark, sf_dir).reversed())


@query(f"WITH {SEQ}, h AS (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) SELECT slots.id, count(h.v) AS out_degree FROM slots LEFT JOIN h ON h.v = slots.id GROUP BY slots.id")
def out_degrees_undirected(spark, sf_dir):
    return G.out_degrees(D.user_seq(spark, sf_dir).undirected())


def _filtered(spark, sf_dir) -> Graph:
    return D.user_seq(spark, sf_dir).filtered(F.col("id") % 7 != 0, F.col("weight") > 20)


FILTERED = SEQ + ", fe AS (SELECT * FROM e WHERE weight > 20 AND src % 7 <> 0 AND dst % 7 <> 0), fv AS (SELECT id FROM v WHERE id % 7 <> 0)"


@query(f"WITH {FILTERED} SELECT (SELECT count(*) FROM fv) AS num_vertices, (SELECT count(*) FROM fe) AS num_edges, n AS vertex_bound, (SELECT max(edge_id) + 1 FROM e) AS edge_bound FROM bound")
def filtered_counts(spark, sf_dir):
    g = _filtered(spark, sf_dir)
    counts = g.vertices.agg(F.count(F.lit(1)).alias("num_vertices")).join(g.edges.agg(F.count(F.lit(1)).alias("num_edges")))
    return counts.withColumn("vertex_bound", F.lit(g.vertex_bound).cast("long")).withColumn("edge_bound", F.lit(g.edge_bound).cast("long"))


@query(f"WITH {FILTERED} SELECT edge_id, src, dst, weight FROM fe")
def filtered_edges(spark, sf_dir):
    return _filtered(spark, sf_dir).edges


@query(f"WITH {SEQ} SELECT src AS v, dst AS other, edge_id FROM e UNION ALL SELECT dst, src, edge_id FROM e")
def incidence(spark, sf_dir):
    return D.user_seq(spark, sf_dir).incidence().select("v", "other", "edge_id")


@query(f"WITH {SEQ} SELECT src, dst, min(edge_id) AS edge_id FROM e GROUP BY src, dst")
def find_edge(spark, sf_dir):
    return D.user_seq(spark, sf_dir).find_edges()


@query(f"WITH {SEQ}, o AS (SELECT src, dst, min(edge_id) AS edge_id FROM e GROUP BY 1, 2), h AS (SELECT src AS s, dst AS t, 0 AS turn, * FROM o UNION ALL SELECT dst, src, 1, * FROM o WHERE src <> dst) SELECT s, t, edge_id, src, dst FROM h QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY turn) = 1")
def find_edge_undirected(spark, sf_dir):
    return D.user_seq(spark, sf_dir).undirected().find_edges()


@query(f"WITH {SEQ}, x AS (SELECT edge_id, src, dst FROM e WHERE edge_id NOT IN (3, 5, 8)), a AS (SELECT 8 AS edge_id, 1 AS src, 2 AS dst UNION ALL SELECT 5, 3, 4 UNION ALL SELECT 3, 5, 6 UNION ALL SELECT max(edge_id) + 1, 7, 8 FROM e) SELECT * FROM x UNION ALL SELECT * FROM a")
def add_and_remove_edges(spark, sf_dir):
    g = D.user_seq(spark, sf_dir).remove_edges([3, 5, 8])
    return g.add_edges(spark.createDataFrame([(1, 2), (3, 4), (5, 6), (7, 8)], "src long, dst long")).edges.select("edge_id", "src", "dst")


@query(f"WITH {SEQ} SELECT edge_id, CASE WHEN src = n - 1 THEN 4 ELSE src END AS src, CASE WHEN dst = n - 1 THEN 4 ELSE dst END AS dst FROM e, bound WHERE src <> 4 AND dst <> 4")
def swap_remove_vertex(spark, sf_dir):
    return D.user_seq(spark, sf_dir).swap_remove_vertex(4).edges.select("edge_id", "src", "dst")


@query(f"WITH {SEQ} SELECT row_number() OVER (ORDER BY edge_id) - 1 AS edge_id, src, dst FROM e WHERE NOT ((src IN (1, 2) OR dst IN (1, 2)) AND weight > 10)")
def clear_and_compact(spark, sf_dir):
    return D.user_seq(spark, sf_dir).clear_vertices([1, 2], F.col("weight") > 10).compact_edges().edges.select("edge_id", "src", "dst")


@query(f"WITH {SEQ} SELECT round(sum(weight), 3) AS total FROM e")
def sum_property(spark, sf_dir):
    return rounded(G.sum_property(D.user_seq(spark, sf_dir), "weight", "edge"), "total", digits=3)


@query(f"WITH {SEQ} SELECT round(sum(weight), 3) AS total FROM e")
def det_reduce(spark, sf_dir):
    return rounded(G.det_sum(D.user_seq(spark, sf_dir).edges, "weight", "edge_id"), "total", digits=3)


# ---- traversal


def _bfs(start: str, along: str, edges: str = "e") -> str:
    return f"r(id, d) AS ({start} UNION SELECT {edges}.{along[1]}, r.d + 1 FROM r JOIN {edges} ON {edges}.{along[0]} = r.id WHERE r.d < 12), b AS (SELECT id, min(d) AS d FROM r GROUP BY id)"


SOURCE = "SELECT (SELECT min(id) FROM v), 0"
DISTANCES = "SELECT slots.id, coalesce(b.d, 9223372036854775807) AS distance FROM slots LEFT JOIN b ON b.id = slots.id"


def _first(g: Graph) -> int:
    return g.vertices.agg(F.min("id")).first()[0]


@query(f"WITH RECURSIVE {SEQ}, {_bfs(SOURCE, ('src', 'dst'))} {DISTANCES}")
def shortest_distances(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    return V.shortest_distances(g, _first(g))


@query(f"WITH RECURSIVE {SEQ}, {_bfs(SOURCE, ('dst', 'src'))} {DISTANCES}")
def shortest_distances_reversed(spark, sf_dir):
    g = D.user_seq(spark, sf_dir).reversed()
    return V.shortest_distances(g, _first(g))


@query(f"WITH RECURSIVE {SEQ}, u AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), {_bfs(SOURCE, ('src', 'dst'), 'u')} {DISTANCES}")
def shortest_distances_undirected(spark, sf_dir):
    g = D.user_seq(spark, sf_dir).undirected()
    return V.shortest_distances(g, _first(g))


@query(f"WITH RECURSIVE {GEO}, r(id, depth) AS (SELECT id, 0 FROM v WHERE id % 4 = 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 9) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def bfs_multi(spark, sf_dir):
    g = D.geo(spark, sf_dir)
    return V.bfs(g, g.vertices.where(F.col("id") % 4 == 0).select("id"))


@query(f"WITH RECURSIVE {GEO}, r(id, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.id % 3 <> 1 AND e.dst % 5 <> 0 AND r.depth < 9) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def bfs_pruned(spark, sf_dir):
    return V.bfs(D.geo(spark, sf_dir), [0], prune_vertex=F.col("id") % 3 == 1, prune_edge=F.col("other") % 5 == 0)


@query(f"""WITH RECURSIVE {SEQ}, m AS MATERIALIZED (SELECT src, dst, min(weight) AS w FROM e GROUP BY src, dst), r(id, d, k) AS (SELECT (SELECT min(id) FROM v), 0.0::DOUBLE, 0 UNION ALL SELECT id, min(d) AS d, k FROM (SELECT m.dst AS id, r.d + m.w AS d, r.k + 1 AS k FROM r JOIN m ON m.src = r.id WHERE r.k < 14) GROUP BY id, k)
SELECT slots.id, round(coalesce(min(d), 'inf'::DOUBLE), 6) AS distance FROM slots LEFT JOIN r ON r.id = slots.id GROUP BY slots.id""")
def dijkstra(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    return rounded(V.dijkstra(g, _first(g), "weight"), "distance")


# ---- components


@query(f"WITH RECURSIVE {GEO}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, root) AS (SELECT id, id FROM v UNION SELECT u.dst, r.root FROM r JOIN u ON u.src = r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY id) SELECT id, root, count(*) OVER (PARTITION BY root) AS size FROM c")
def components_undirected(spark, sf_dir):
    return K.components(D.geo(spark, sf_dir).undirected())


@query(f"WITH RECURSIVE {GEO}, r(id, root) AS (SELECT id, id FROM v UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY id) SELECT id, root, count(*) OVER (PARTITION BY root) AS size FROM c")
def components_directed(spark, sf_dir):
    return K.components(D.geo(spark, sf_dir))


CLOSURE = SEQ + ", s AS MATERIALIZED (SELECT DISTINCT src, dst FROM e), r(x, y) AS (SELECT id, id FROM v UNION SELECT r.x, s.dst FROM r JOIN s ON s.src = r.y)"


@query(f"WITH RECURSIVE {CLOSURE} SELECT a.x AS id, min(a.y) AS root FROM r a JOIN r b ON a.x = b.y AND a.y = b.x GROUP BY a.x")
def strong_components(spark, sf_dir):
    return K.strong_components(D.user_seq(spark, sf_dir))


@query(f"WITH RECURSIVE {CLOSURE}, c AS (SELECT y AS id, min(x) AS root FROM r GROUP BY y), best AS (SELECT root FROM c GROUP BY root ORDER BY count(*) DESC, root LIMIT 1) SELECT slots.id, CASE WHEN c.root = (SELECT root FROM best) THEN 1 ELSE 0 END AS inside FROM slots LEFT JOIN c ON c.id = slots.id")
def largest_component(spark, sf_dir):
    return K.largest_component(D.user_seq(spark, sf_dir))


# ---- topology

SIMPLE = "p AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst)"


@query(f"WITH {SEQ}, {SIMPLE} SELECT count(*) AS triangles FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b")
def triangles(spark, sf_dir):
    return T.count_triangles(D.user_seq(spark, sf_dir))


@query(f"WITH {SEQ}, {SIMPLE}, t AS (SELECT count(*) AS n FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b), d AS (SELECT count(*) AS d FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id) SELECT round(3.0 * (SELECT n FROM t) / sum(d * (d - 1) / 2), 9) AS clustering FROM d")
def global_clustering(spark, sf_dir):
    return rounded(T.global_clustering(D.user_seq(spark, sf_dir)), "clustering", digits=9)


@query(f"WITH {SEQ}, m AS (SELECT src, dst, count(*) AS m FROM e WHERE src <> dst GROUP BY src, dst) SELECT round(sum(least(x.m, coalesce(y.m, 0))) / sum(x.m)::DOUBLE, 9) AS reciprocity FROM m x LEFT JOIN m y ON y.src = x.dst AND y.dst = x.src")
def reciprocity(spark, sf_dir):
    return rounded(T.reciprocity(D.user_seq(spark, sf_dir)), "reciprocity", digits=9)


@query(f"WITH RECURSIVE {GEO}, r(id, level) AS (SELECT id, 0 FROM v WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id) SELECT id, max(level)::INT AS level FROM r GROUP BY id")
def topological_sort(spark, sf_dir):
    return T.topological_sort(D.geo(spark, sf_dir))


def _cycles(name: str, edges: str) -> str:
    """Pairs of vertices of which the first leads to the second, and whether none leads to itself."""
    return f"{name}_s AS MATERIALIZED (SELECT DISTINCT src, dst FROM {edges}), {name}(x, y) AS (SELECT src, dst FROM {name}_s UNION SELECT {name}.x, {name}_s.dst FROM {name} JOIN {name}_s ON {name}_s.src = {name}.y)"


@query(f"""WITH RECURSIVE {SEQ}, {GEO.replace("e AS MATERIALIZED", "ge AS MATERIALIZED").split(", v AS")[0]}, {_cycles("a", "ge")}, {_cycles("b", "(SELECT src, dst FROM e WHERE src < dst)")}, {_cycles("c", "e")}
SELECT NOT EXISTS (SELECT 1 FROM a WHERE x = y) AS geo, NOT EXISTS (SELECT 1 FROM b WHERE x = y) AS later, NOT EXISTS (SELECT 1 FROM c WHERE x = y) AS user_seq""")
def is_dag(spark, sf_dir):
    seq = D.user_seq(spark, sf_dir)
    return spark.createDataFrame([(T.is_dag(D.geo(spark, sf_dir)), T.is_dag(D.later(seq)), T.is_dag(seq))], "geo boolean, later boolean, user_seq boolean")


@query(f"WITH RECURSIVE {GEO}, n AS (SELECT max(id) + 1 AS n FROM v), r(id, d) AS (SELECT id, 0 FROM v WHERE id % 4 = 0 UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.id), roots AS (SELECT id FROM v WHERE id % 4 = 0) SELECT s.id, coalesce(((1 - d % 2))::INT, 0) AS colour FROM (SELECT unnest(range(n)) AS id FROM n) s LEFT JOIN r ON r.id = s.id")
def bipartition(spark, sf_dir):
    return T.bipartition(D.geo(spark, sf_dir))


@query(f"""WITH RECURSIVE {SEQ}, h AS MATERIALIZED (SELECT src AS id, dst AS o FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst), l AS MATERIALIZED (SELECT id, 2 * (SELECT count(*) FROM e WHERE src = v.id AND dst = v.id) AS l FROM v),
r(k, id, c) AS (SELECT 0, id, l + (SELECT count(*) FROM h WHERE h.id = l.id) FROM l UNION ALL SELECT k + 1, id, max(c) FROM (SELECT k, id, least(c, n + l) AS c FROM (SELECT r.k, h.id, r.c, l, row_number() OVER (PARTITION BY h.id ORDER BY r.c DESC) AS n FROM r JOIN h ON h.o = r.id JOIN l ON l.id = h.id WHERE r.k < 60) UNION ALL SELECT r.k, l.id, l.l FROM r JOIN l ON l.id = r.id WHERE r.k < 60) GROUP BY k, id)
SELECT slots.id, coalesce(c, -1)::BIGINT AS core FROM slots LEFT JOIN r ON r.id = slots.id AND k = 60""")
def core_numbers(spark, sf_dir):
    return T.core_numbers(D.user_seq(spark, sf_dir).undirected())


# ---- centrality


def _pagerank_sql(share: str, sweeps: int) -> str:
    step = f"SELECT y.id, {{k}} + 1 AS k, 0.15 * p + 0.85 * (p * (SELECT coalesce(sum(rank), 0) FROM r{{k}} WHERE id NOT IN (SELECT src FROM share)) + coalesce(came, 0)) AS rank FROM base y LEFT JOIN (SELECT dst, sum(rank * share) AS came FROM r{{k}} JOIN share ON share.src = r{{k}}.id GROUP BY dst) c ON c.dst = y.id"
    steps = "".join(f", r{k + 1} AS MATERIALIZED ({step.format(k=k)})" for k in range(sweeps))
    return f"{share}, r0 AS MATERIALIZED (SELECT id, 0 AS k, p AS rank FROM base){steps} SELECT id, round(rank, 9) AS rank FROM r{sweeps}"


SHARES = "share AS MATERIALIZED (SELECT src, dst, sum({w}) / (sum(sum({w})) OVER (PARTITION BY src)) AS share FROM e GROUP BY src, dst)"
EVEN = "base AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS p FROM v)"


@query(f"WITH {SEQ}, {_pagerank_sql(SHARES.format(w='1.0::DOUBLE') + ', ' + EVEN, 10)}")
def pagerank(spark, sf_dir):
    return rounded(C.pagerank(D.user_seq(spark, sf_dir), epsilon=0, max_iter=10)[0], "rank", digits=9)


@query(f"WITH {SEQ}, {_pagerank_sql(SHARES.format(w='weight') + ', base AS MATERIALIZED (SELECT id, CASE WHEN id % 3 = 0 THEN 0.01::DOUBLE ELSE 0 END AS p FROM v)', 6)}")
def pagerank_weighted_personalised(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    p = g.vertices.where(F.col("id") % 3 == 0).select("id", F.lit(0.01).alias("p"))
    return rounded(C.pagerank(g, epsilon=0, max_iter=6, weight="weight", personalisation=p)[0], "rank", digits=9)


@query(f"WITH {PART}, {_pagerank_sql(SHARES.format(w='1.0::DOUBLE') + ', ' + EVEN, 3)}")
def pagerank_with_sinks(spark, sf_dir):
    return rounded(C.pagerank(D.supp_part(spark, sf_dir), epsilon=0, max_iter=3)[0], "rank", digits=9)


def _eigenvector_sql(sweeps: int) -> str:
    steps = "".join(
        f", y{k + 1} AS MATERIALIZED (SELECT v.id, coalesce(sum(x * w), 0) AS y FROM v LEFT JOIN m ON m.dst = v.id LEFT JOIN x{k} ON x{k}.id = m.src GROUP BY v.id), x{k + 1} AS MATERIALIZED (SELECT id, y / (SELECT sqrt(sum(y * y)) FROM y{k + 1}) AS x FROM y{k + 1})" for k in range(sweeps)
    )
    return f"m AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS w FROM e GROUP BY src, dst), x0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v){steps} SELECT id, round(x, 9) AS x FROM x{sweeps}"


@query(f"WITH {SEQ}, {_eigenvector_sql(8)}")
def eigenvector(spark, sf_dir):
    return rounded(C.eigenvector(D.user_seq(spark, sf_dir), epsilon=0, max_iter=8)[0], "x", digits=9)


def _paths(edges: str) -> str:
    """Hops and number of shortest paths of all pairs, and of each source what depends on each vertex: walks of the least length are shortest paths."""
    return f"""mm AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS m FROM {edges} WHERE src <> dst GROUP BY 1, 2), w(s, v, d, n) AS (SELECT id, id, 0, 1.0::DOUBLE FROM v UNION ALL SELECT s, dst, d + 1, sum(n * m) FROM w JOIN mm ON mm.src = w.v WHERE d < 9 GROUP BY s, dst, d),
dist AS MATERIALIZED (SELECT s, v, min(d) AS d, arg_min(n, d) AS n FROM w GROUP BY s, v), dep AS MATERIALIZED (SELECT a.s, a.v, sum(a.n * b.n / c.n) AS dep FROM dist a JOIN dist b ON b.s = a.v JOIN dist c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d WHERE b.v <> a.v GROUP BY a.s, a.v)"""


@query(f"WITH RECURSIVE {SEQ}, {_paths('e')} SELECT slots.id, round(coalesce(sum(dep), 0), 6) AS betweenness FROM slots LEFT JOIN dep ON dep.v = slots.id AND dep.s <> slots.id GROUP BY slots.id")
def betweenness(spark, sf_dir):
    return rounded(C.betweenness(D.user_seq(spark, sf_dir))[0], "betweenness")


@query(f"""WITH RECURSIVE {SEQ}, {_paths("(SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)")}, arcs AS (SELECT DISTINCT src AS a, dst AS b FROM mm),
share AS MATERIALIZED (SELECT a, b, sum(x.n / y.n * (1 + coalesce(dep, 0))) AS share FROM arcs JOIN dist x ON x.v = a JOIN dist y ON y.s = x.s AND y.v = b AND y.d = x.d + 1 LEFT JOIN dep ON dep.s = x.s AND dep.v = b GROUP BY a, b)
SELECT edge_id, round((coalesce(p.share, 0) + coalesce(q.share, 0)) / 2, 6) AS betweenness FROM e LEFT JOIN share p ON p.a = src AND p.b = dst LEFT JOIN share q ON q.a = dst AND q.b = src""")
def betweenness_edges(spark, sf_dir):
    return rounded(C.betweenness(D.user_seq(spark, sf_dir).undirected())[1], "betweenness")


# ---- block models

SBM = "b AS (SELECT id, id % 8 AS grp FROM v), m AS MATERIALIZED (SELECT x.grp AS r, y.grp AS s, count(*) AS m FROM e JOIN b x ON x.id = e.src JOIN b y ON y.id = e.dst GROUP BY 1, 2), w AS (SELECT grp, count(*) AS wr FROM b GROUP BY grp), t AS MATERIALIZED (SELECT w.grp, wr, coalesce((SELECT sum(m) FROM m WHERE r = w.grp), 0)::BIGINT AS mrp, coalesce((SELECT sum(m) FROM m WHERE s = w.grp), 0)::BIGINT AS mrm FROM w)"
UND = "b AS (SELECT id, id % 8 AS grp FROM v), m AS MATERIALIZED (SELECT least(x.grp, y.grp) AS r, greatest(x.grp, y.grp) AS s, count(*) AS m FROM e JOIN b x ON x.id = e.src JOIN b y ON y.id = e.dst GROUP BY 1, 2), w AS (SELECT grp, count(*) AS wr FROM b GROUP BY grp), t AS MATERIALIZED (SELECT w.grp, wr, (coalesce((SELECT sum(m) FROM m WHERE r = w.grp), 0) + coalesce((SELECT sum(m) FROM m WHERE s = w.grp), 0))::BIGINT AS mrp, 0::BIGINT AS mrm FROM w)"


@query(f"WITH {SEQ}, {SBM} SELECT r, s, m FROM m")
def sbm_pairs(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    return B.pair_counts(g, D.blocks(g))


@query(f"WITH {SEQ}, {SBM} SELECT grp, wr, mrp, mrm FROM t")
def sbm_groups(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    return B.group_totals(g, D.blocks(g))


@query(f"WITH {PART}, {UND} SELECT grp, wr, mrp, mrm FROM t")
def sbm_groups_undirected(spark, sf_dir):
    g = D.supp_part(spark, sf_dir).undirected()
    return B.group_totals(g, D.blocks(g))


@query(f"WITH {SEQ}, {SBM} SELECT round((SELECT sum(-lgamma(m + 1)) FROM m) + (SELECT sum(lgamma(mrp + 1) + lgamma(mrm + 1)) FROM t), 4) AS entropy")
def sbm_entropy(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    return rounded(B.entropy(g, D.blocks(g)), "entropy", digits=4)


@query(f"WITH {PART}, {UND} SELECT round((SELECT sum(-lgamma(m + 1) - CASE WHEN r = s THEN m * ln(2) ELSE 0 END) FROM m) + (SELECT sum(mrp * ln(wr)) FROM t), 4) AS entropy")
def sbm_entropy_undirected(spark, sf_dir):
    g = D.supp_part(spark, sf_dir).undirected()
    return rounded(B.entropy(g, D.blocks(g), deg_corr=False), "entropy", digits=4)


@query(f"WITH {SEQ}, {SBM}, x AS (SELECT (SELECT count(*) FROM t) AS b, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS e, (SELECT sum(lgamma(wr + 1)) FROM t) AS g) SELECT round(lgamma(n) - lgamma(b) - lgamma(n - b + 1) + lgamma(n + 1) - g + ln(n), 6) AS partition_dl, round(lgamma(b * b + e) - lgamma(e + 1) - lgamma(b * b), 6) AS edges_dl FROM x")
def sbm_description_lengths(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    return rounded(B.partition_dl(D.blocks(g)).join(B.edges_dl(g, D.blocks(g))), "partition_dl", "edges_dl")


def _changed_pairs_sql(edges: str, directed: bool) -> str:
    """The price of a move of every vertex, from the pairs of groups that it changes and the edge ends of its two groups."""
    pair = "r, s" if directed else "least(r, s) AS r, greatest(r, s) AS s"
    loops = "" if directed else " - CASE WHEN r = s THEN d * ln(2) ELSE 0 END"
    after = "lgamma(mrp + a + 1) + lgamma(mrm + z + 1) - lgamma(mrp + 1) - lgamma(mrm + 1)" if directed else "lgamma(mrp + a + z + 1) - lgamma(mrp + 1)"
    return f"""WITH {edges}, {SBM if directed else UND}, moves AS (SELECT id AS k, grp AS f, (id + 3) % 8 AS g FROM b),
inc AS (SELECT src AS k, dst % 8 AS x, true AS ahead, count(*) AS c FROM e WHERE src <> dst GROUP BY 1, 2 UNION ALL SELECT dst, src % 8, false, count(*) FROM e WHERE src <> dst GROUP BY 1, 2), loops AS (SELECT src AS k, count(*) AS c FROM e WHERE src = dst GROUP BY 1),
ways AS (SELECT k, f AS own, -1 AS sign FROM moves UNION ALL SELECT k, g, 1 FROM moves),
steps AS (SELECT k, CASE WHEN ahead THEN own ELSE x END AS r, CASE WHEN ahead THEN x ELSE own END AS s, sign * c AS d FROM ways JOIN inc USING (k) UNION ALL SELECT k, own, own, sign * c FROM ways JOIN loops USING (k)),
d AS (SELECT k, r, s, sum(d) AS d FROM (SELECT k, {pair}, d FROM steps) GROUP BY ALL),
p AS (SELECT k, sum(lgamma(coalesce(m, 0) + 1) - lgamma(coalesce(m, 0) + d + 1){loops}) AS p FROM d LEFT JOIN m USING (r, s) GROUP BY k),
o AS (SELECT src AS k, count(*) AS o FROM e GROUP BY 1), i AS (SELECT dst AS k, count(*) AS i FROM e GROUP BY 1),
y AS (SELECT k, own, sign * coalesce(o, 0) AS a, sign * coalesce(i, 0) AS z FROM ways LEFT JOIN o USING (k) LEFT JOIN i USING (k)),
h AS (SELECT k, sum({after}) AS h FROM (SELECT k, a, z, coalesce(mrp, 0) AS mrp, coalesce(mrm, 0) AS mrm FROM y LEFT JOIN t ON t.grp = own) GROUP BY k)
SELECT k AS move_id, round(coalesce(p, 0) + h, 5) + 0.0 AS ds FROM h LEFT JOIN p USING (k)"""


def _every_move(g: Graph) -> DataFrame:
    return g.vertices.select(F.col("id").alias("move_id"), "id", ((F.col("id") + 3) % 8).alias("to"))


@query(_changed_pairs_sql(SEQ, True))
def sbm_move_prices(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    return rounded(B.move_prices(g, D.blocks(g), _every_move(g)), "ds", digits=5).withColumn("ds", F.col("ds") + F.lit(0.0))


@query(_changed_pairs_sql(SEQ, False))
def sbm_move_prices_undirected(spark, sf_dir):
    g = D.user_seq(spark, sf_dir).undirected()
    return rounded(B.move_prices(g, D.blocks(g), _every_move(g)), "ds", digits=5).withColumn("ds", F.col("ds") + F.lit(0.0))


@query()
def sbm_sweep(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    return B.sweep(g, D.blocks(g, 4), 4, beta=1.0, n_iter=2, seed=11).partition


# ---- functions


@query("SELECT p_partkey, round(lgamma(p_size + 1), 9) AS lgamma1p, CASE WHEN p_size = 0 THEN 0 ELSE round(ln(p_size), 9) END AS safelog, round(p_size * ln(p_size), 9) AS xlogx, round(CASE WHEN p_size <= 5 THEN 0 ELSE lgamma(p_size + 1) - lgamma(6) - lgamma(p_size - 4) END, 9) AS lbinom FROM part")
def special_functions(spark, sf_dir):
    x = F.col("p_size")
    return D.table(spark, sf_dir, "part").select("p_partkey", F.round(lgamma1p(x), 9).alias("lgamma1p"), F.round(safelog(x), 9).alias("safelog"), F.round(xlogx(x), 9).alias("xlogx"), F.round(lbinom(x, F.lit(5)), 9).alias("lbinom"))


@query("""SELECT o_orderkey, ((o_orderkey * 7919) % 65536 + 65536 + 32768) % 65536 - 32768 AS as_int16, o_orderkey % 256 AS as_byte, CASE WHEN o_totalprice >= 32767 THEN 32767 ELSE trunc(o_totalprice)::INT END AS price_int16, least(trunc(o_totalprice / 100)::BIGINT, 255) AS price_byte,
o_orderkey::VARCHAR AS as_string, o_orderkey::DOUBLE AS as_double, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS parsed FROM orders""")
def conversions(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    text = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit(" "), k.cast("string")))
    return D.table(spark, sf_dir, "orders").select(
        k,
        convert(k * 7919, Kind.INT64, Kind.INT16).cast("long").alias("as_int16"),
        convert(k, Kind.INT64, Kind.BOOL).cast("long").alias("as_byte"),
        convert(price, Kind.DOUBLE, Kind.INT16).cast("int").alias("price_int16"),
        convert(price / 100, Kind.DOUBLE, Kind.BOOL).cast("long").alias("price_byte"),
        convert(k, Kind.INT64, Kind.STRING).alias("as_string"),
        convert(k, Kind.INT64, Kind.DOUBLE).alias("as_double"),
        convert(text, Kind.STRING, Kind.INT64).alias("parsed"),
    )


# ---- file formats


@query(f"WITH {GEO} SELECT edge_id, src, dst FROM (SELECT dst AS edge_id, src, dst FROM e)")
def edge_list_round_trip(spark, sf_dir):
    """Written as delimited text, and read again in parallel; in a forest an edge goes by its target."""
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    edgelist.write(D.geo(spark, sf_dir).edges, path)
    return edgelist.read_plain(spark, path).select(F.col("dst").alias("edge_id"), "src", "dst")


def _file_round_trip(spark, sf_dir, module) -> DataFrame:
    """The edges of user_seq, written to a file of the format and read by a task, as (src, dst, weight)."""
    g = D.user_seq(spark, sf_dir)
    g = Graph(g.slots(), g.edges, g.vertex_bound, g.edge_bound)
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    module.write(spark, g, path)
    found = module.read(spark, path)
    weight = F.col("weight").cast("double") if dict(found.edges.dtypes)["weight"] == "string" else F.col("weight")
    return found.edges.select("src", "dst", weight.alias("weight"))


WHOLE = f"WITH {SEQ} SELECT src, dst, weight FROM e"


@query(WHOLE)
def binary_round_trip(spark, sf_dir):
    return _file_round_trip(spark, sf_dir, binary)


@query(WHOLE)
def graphml_round_trip(spark, sf_dir):
    return _file_round_trip(spark, sf_dir, graphml)


@query(f"WITH {SEQ}, n AS (SELECT id, row_number() OVER (ORDER BY id::VARCHAR) - 1 AS k FROM slots) SELECT a.k AS src, b.k AS dst, weight FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst")
def dot_round_trip(spark, sf_dir):
    """DOT numbers vertices anew, by their names."""
    return _file_round_trip(spark, sf_dir, dot)


# ---- lookups, masks and views


@query(f"WITH {SEQ} SELECT event_id AS edge_id, src, dst FROM events LEFT JOIN e ON e.edge_id = event_id")
def endpoints(spark, sf_dir):
    ids = D.table(spark, sf_dir, "events").select(F.col("event_id").alias("edge_id"))
    return D.user_seq(spark, sf_dir).endpoints(ids)


@query(f"WITH {SEQ} SELECT event_id AS edge_id, user_id AS v, CASE WHEN src = user_id THEN dst WHEN dst = user_id THEN src END AS other FROM events LEFT JOIN e ON e.edge_id = event_id")
def opposite(spark, sf_dir):
    pairs = D.table(spark, sf_dir, "events").select(F.col("event_id").alias("edge_id"), F.col("user_id").alias("v"))
    return D.user_seq(spark, sf_dir).opposite(pairs)


@query(f"WITH {SEQ} SELECT edge_id, dst AS rev_src, src AS rev_dst, dst AS near, src AS far FROM e")
def edge_turns(spark, sf_dir):
    e, (a, b) = D.user_seq(spark, sf_dir).edges, reversed_edge(F.col("src"), F.col("dst"))
    near, far = anchored_at(F.col("src"), F.col("dst"), F.col("dst"))
    return e.select("edge_id", a.alias("rev_src"), b.alias("rev_dst"), near.alias("near"), far.alias("far"))


@query(f"WITH {SEQ}, a AS (SELECT min(id) AS v FROM v) SELECT 'out' AS half, dst AS other, edge_id FROM e, a WHERE src = v UNION ALL SELECT 'in', src, edge_id FROM e, a WHERE dst = v")
def vertex_block(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    return g.block(_first(g))


@query(f"WITH {SEQ} SELECT dst AS v, src AS other, edge_id FROM e")
def in_incidence(spark, sf_dir):
    return D.user_seq(spark, sf_dir).into().select("v", "other", "edge_id")


def _masked(spark, sf_dir) -> Graph:
    g = D.user_seq(spark, sf_dir)
    return g.masked(g.slots().select("id", (F.col("id") % 5).alias("keep")), spark.range(g.edge_bound).select(F.col("id").alias("edge_id"), (F.col("id") % 3).alias("keep")))


MASKED = SEQ + ", fe AS (SELECT * FROM e WHERE edge_id % 3 <> 0 AND src % 5 <> 0 AND dst % 5 <> 0), fv AS (SELECT id FROM v WHERE id % 5 <> 0)"


@query(f"WITH {MASKED} SELECT edge_id, src, dst FROM fe")
def masked_edges(spark, sf_dir):
    return _masked(spark, sf_dir).edges.select("edge_id", "src", "dst")


@query(f"""WITH {MASKED}, x AS (SELECT id, (SELECT count(*) FROM e WHERE src = v.id) AS o, (SELECT count(*) FROM e WHERE dst = v.id) AS i FROM v), y AS (SELECT id, (SELECT count(*) FROM fe WHERE src = fv.id) AS o, (SELECT count(*) FROM fe WHERE dst = fv.id) AS i FROM fv)
SELECT 'directed' AS name, id, o::BIGINT AS out_edges FROM x UNION ALL SELECT 'reversed', id, i FROM x UNION ALL SELECT 'undirected', id, o + i FROM x UNION ALL SELECT 'filtered directed', id, o FROM y UNION ALL SELECT 'filtered reversed', id, i FROM y UNION ALL SELECT 'filtered undirected', id, o + i FROM y""")
def six_views(spark, sf_dir):
    """The out-degrees of every vertex, by one kernel on each of the six views."""

    def kernel(view):
        counts = view.out().groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("out_edges"))
        return view.vertices.select(F.lit(view.view).alias("name"), "id").join(counts, "id", "left").select("name", "id", F.coalesce("out_edges", F.lit(0)).cast("long").alias("out_edges"))

    out = None
    for g in (D.user_seq(spark, sf_dir), _masked(spark, sf_dir)):
        for view in (g, g.reversed(), g.undirected()):
            found = view.dispatch(kernel)
            out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH RECURSIVE {SEQ}, x AS MATERIALIZED (SELECT src, dst FROM e WHERE src % 7 <> 0 AND dst % 7 <> 0 AND weight > 40 AND edge_id % 4 <> 1), {_bfs('SELECT (SELECT min(id) FROM v WHERE id % 7 <> 0), 0', ('src', 'dst'), 'x')} {DISTANCES}")
def filtered_twice_distances(spark, sf_dir):
    """Vertices are filtered, then edges, then edges are taken away."""
    g = D.user_seq(spark, sf_dir).filtered(F.col("id") % 7 != 0).filtered(edge=F.col("weight") > 40)
    g = g.remove_edges(g.edges.where(F.col("edge_id") % 4 == 1).select("edge_id"))
    return V.shortest_distances(g, _first(g))


@query(f"""WITH RECURSIVE {SEQ}, x AS MATERIALIZED (SELECT src, dst, min(weight) AS w FROM e WHERE weight > 20 AND dst % 7 <> 0 AND (src % 7 <> 0 OR src = (SELECT min(id) FROM v WHERE id % 7 = 0)) GROUP BY src, dst),
r(id, d, k) AS (SELECT (SELECT min(id) FROM v WHERE id % 7 = 0), 0.0::DOUBLE, 0 UNION ALL SELECT id, min(d) AS d, k FROM (SELECT x.dst AS id, r.d + x.w AS d, r.k + 1 AS k FROM r JOIN x ON x.src = r.id WHERE r.k < 14) GROUP BY id, k)
SELECT slots.id, round(coalesce(min(d), 'inf'::DOUBLE), 6) AS distance FROM slots LEFT JOIN r ON r.id = slots.id AND r.id % 7 <> 0 GROUP BY slots.id""")
def dijkstra_from_filtered(spark, sf_dir):
    """From a source that the filter took away, which may be left and is not reached."""
    whole = D.user_seq(spark, sf_dir)
    source = whole.vertices.where(F.col("id") % 7 == 0).agg(F.min("id")).first()[0]
    return rounded(V.dijkstra(_filtered(spark, sf_dir), source, "weight"), "distance")


@query(f"""WITH {SEQ}, c AS (SELECT edge_id, min(struct_pack(v := v, half := half)) AS f FROM (SELECT edge_id, src AS v, 0 AS half FROM e WHERE src IN (1, 2) UNION ALL SELECT edge_id, dst, 1 FROM e WHERE dst IN (1, 2) AND src <> dst) GROUP BY edge_id),
o AS (SELECT edge_id, row_number() OVER (ORDER BY f.v DESC, f.half DESC, edge_id DESC) - 1 AS k FROM c), n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, n_nationkey % 3 + 3 AS src, n_nationkey % 4 + 4 AS dst FROM nation), m AS (SELECT count(*) AS m FROM o), top AS (SELECT max(edge_id) + 1 AS t FROM e)
SELECT edge_id, src, dst FROM e WHERE edge_id NOT IN (SELECT edge_id FROM o) UNION ALL SELECT coalesce(o.edge_id, t + n.k - m), src::BIGINT, dst::BIGINT FROM n LEFT JOIN o USING (k), m, top""")
def clear_then_add(spark, sf_dir):
    """The ids of a cleared vertex's edges are given out anew, the last released first."""
    g = D.user_seq(spark, sf_dir).clear_vertices([1, 2])
    new = D.table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 3 + 3).cast("long").alias("src"), (F.col("n_nationkey") % 4 + 4).cast("long").alias("dst"))
    return g.add_edges(new, ["n_nationkey"]).edges.select("edge_id", "src", "dst")


@query(f"WITH RECURSIVE {GEO}, r(id, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < (SELECT min(d) FROM (SELECT 1 AS d FROM e WHERE src = 0 AND dst % 4 = 1))) SELECT id, min(depth)::BIGINT AS depth FROM r GROUP BY id")
def bfs_stopped(spark, sf_dir):
    """From region 0 until a nation is reached."""
    return V.bfs(D.geo(spark, sf_dir), [0], stop=F.col("id") % 4 == 1)


@query(f"WITH RECURSIVE {GEO}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, root) AS (SELECT id, id FROM v UNION SELECT u.dst, r.root FROM r JOIN u ON u.src = r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY id) SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM c")
def component_labels(spark, sf_dir):
    return K.labels(K.components(D.geo(spark, sf_dir).undirected()))


@query(f"WITH RECURSIVE {GEO}, l(id, d) AS (SELECT id, 0 FROM v UNION SELECT e.src, l.d + 1 FROM l JOIN e ON e.dst = l.id), m AS (SELECT id, max(d) AS d FROM l GROUP BY id) SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS label FROM m")
def strong_labels(spark, sf_dir):
    """Of a forest, where every vertex is a component: leaves first."""
    g = D.geo(spark, sf_dir)
    return K.strong_labels(g, g.vertices.select("id", F.col("id").alias("root")))


# ---- columns


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE ((o_orderkey * 31) % 65536 + 65536 + 32768) % 65536 - 32768 END AS held, CASE WHEN o_orderkey % 3 = 0 THEN '9' ELSE (((o_orderkey * 31) % 65536 + 65536 + 32768) % 65536 - 32768)::VARCHAR END AS text FROM orders")
def copied_and_wrapped(spark, sf_dir):
    """A column copied to another kind, then written and read as text."""
    df = D.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 31).alias("x"))
    df = copy_prop(df, "o_orderkey", "x", Kind.INT64, "held", Kind.INT16)
    wrap = DynWrap("held", Kind.INT16, Kind.STRING)
    df = wrap.put(df, F.lit("9"), F.col("o_orderkey") % 3 == 0)
    df = wrap.put(df, F.lit("none"), F.col("o_orderkey") % 3 == 1)  # no number: changes nothing
    return df.select("o_orderkey", F.col("held").cast("long").alias("held"), wrap.get().alias("text"))


@query("SELECT CASE WHEN min(o_orderkey) FILTER (WHERE o_orderkey % 10 = 7) IS NULL THEN NULL ELSE min(o_orderkey) FILTER (WHERE o_orderkey % 10 = 7) END AS first_bad, count(*) FILTER (WHERE o_orderkey % 10 <> 7) AS made FROM orders")
def copy_failures(spark, sf_dir):
    """The smallest key that can't be converted, and how many can."""
    text = F.when(F.col("o_orderkey") % 10 == 7, F.lit("1.5")).otherwise(F.col("o_orderkey").cast("string"))
    out, first = copied(D.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("x")), "o_orderkey", "x", Kind.STRING, "y", Kind.INT64)
    return out.agg(F.lit(first).cast("long").alias("first_bad"), F.count("y").alias("made"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR || repeat('0', 18) ELSE '0.00000' || o_orderkey::VARCHAR END AS plain, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS parsed, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS total FROM orders WHERE o_orderkey % 10 <> 0")
def conversions_of_text(spark, sf_dir):
    """Doubles print without exponents; a line break is no part of a number; a vector fails as a whole."""
    k = F.col("o_orderkey")
    x = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit("e18"))).otherwise(F.concat(F.lit("0.00000"), k.cast("string"))).cast("double")
    text = F.when(k % 3 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit("\n")))
    pair = convert(F.array(text, F.lit("1")), Kind.VECTOR_STRING, Kind.VECTOR_INT64)
    # ids that end in 0 would lose it behind the point
    df = D.table(spark, sf_dir, "orders").where(k % 10 != 0)
    return df.select(k, convert(x, Kind.DOUBLE, Kind.STRING).alias("plain"), convert(text, Kind.STRING, Kind.INT64).alias("parsed"), (pair[0] + pair[1]).alias("total"))


@query("SELECT name FROM (VALUES ('bool'), ('int16_t'), ('int32_t'), ('int64_t'), ('double'), ('long double'), ('string'), ('vector<bool>'), ('vector<int16_t>'), ('vector<int32_t>'), ('vector<int64_t>'), ('vector<double>'), ('vector<long double>'), ('vector<string>'), ('python::object')) t(name)")
def value_types(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in properties.value_types()], "name string")


@query(f"WITH {SEQ} SELECT slots.id, CASE WHEN slots.id = 3 THEN 41 WHEN v.id IS NULL THEN 0 ELSE slots.id * 2 END AS value FROM slots LEFT JOIN v ON v.id = slots.id")
def property_map(spark, sf_dir):
    """A map over every slot: a column put at once, and a slot set alone."""
    g = D.user_seq(spark, sf_dir)
    held = properties.GraphBuilder(spark, g).new_vertex_property("int64_t")
    held.put(g.vertices.select("id", (F.col("id") * 2).alias("value")))
    held[3] = 41
    return held.frame()


# ---- reductions


@query(f"WITH {SEQ}, n AS (SELECT count(*) AS n, (count(*) + 99) // 100 AS c FROM e), k AS (SELECT weight, CASE WHEN edge_id < (n % c) * (n // c + 1) THEN edge_id // (n // c + 1) ELSE n % c + (edge_id - (n % c) * (n // c + 1)) // (n // c) END AS chunk FROM e, n) SELECT chunk, round(sum(weight), 4) AS partial FROM k GROUP BY chunk")
def chunk_partials(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    plan = R.Plan(g.num_edges(), 100)
    return rounded(R.partials(g.edges, plan, "edge_id", "weight", lambda v, s: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)), "partial", digits=4)


@query(f"WITH {SEQ}, n AS (SELECT count(*) AS n FROM e) SELECT round(sum(weight), 3) AS result, round(sum(weight), 3) AS by_lanes FROM e")
def reductions(spark, sf_dir):
    """Chunks folded in order, and an array summed by lanes."""
    g = D.user_seq(spark, sf_dir)
    plan = R.Plan(g.num_edges(), 500)
    add = lambda a, x: a + x
    one = R.try_det_reduce(g.edges, plan, "edge_id", "weight", lambda v, s: F.aggregate(v, F.lit(0.0), add), lambda v: F.when(F.exists(v, lambda x: x < 0), F.lit("a weight is negative")), F.lit(0.0), add)
    two = R.det_reduce(g.edges, plan, "edge_id", "weight", lambda v, s: R.chunked_sum(v, 8), F.lit(0.0), add)
    return rounded(one.join(two.withColumnRenamed("result", "by_lanes")), "result", "by_lanes", digits=3)


# ---- block-model states


def _dense_sql(edges: str, directed: bool) -> str:
    """Dense entropies before and after each move, in full."""
    r, s = ("x.grp", "y.grp") if directed else ("least(x.grp, y.grp)", "greatest(x.grp, y.grp)")
    places = "a.w * b.w" if directed else "CASE WHEN r = s THEN a.w * (a.w + 1) / 2 ELSE a.w * b.w END"
    return f"""WITH {edges}, b AS MATERIALIZED (SELECT k.id AS k, v.id, CASE WHEN v.id = k.id THEN (v.id + 3) % 8 ELSE v.id % 8 END AS grp FROM v k, v UNION ALL SELECT -1, id, id % 8 FROM v),
w AS (SELECT k, grp, count(*) AS w FROM b GROUP BY ALL), m AS (SELECT x.k, {r} AS r, {s} AS s, count(*) AS m FROM e JOIN b x ON x.id = e.src JOIN b y ON y.id = e.dst AND y.k = x.k GROUP BY ALL),
p AS (SELECT m.k, m, {places} AS n FROM m JOIN w a ON a.k = m.k AND a.grp = r JOIN w b ON b.k = m.k AND b.grp = s),
h AS (SELECT k, sum(CASE WHEN n - 1 <= 0 THEN 0 ELSE lgamma(n + m) - lgamma(m + 1) - lgamma(n) END) AS h FROM p GROUP BY k) SELECT k AS move_id, round(h - (SELECT h FROM h WHERE k = -1), 4) + 0.0 AS ds FROM h WHERE k >= 0"""


@query(_dense_sql(SEQ, True))
def sbm_dense_prices(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    state = S.BlockState.of(g, D.blocks(g))
    prices = state.price(state.record(_every_move(g)), S.EntropyParams(deg_corr=False), dense=True)
    return rounded(prices, "ds", digits=4).withColumn("ds", F.col("ds") + F.lit(0.0))


@query(_dense_sql(SEQ, False))
def sbm_dense_prices_undirected(spark, sf_dir):
    g = D.user_seq(spark, sf_dir).undirected()
    return rounded(S.dense_prices(g, D.blocks(g), _every_move(g)), "ds", digits=4).withColumn("ds", F.col("ds") + F.lit(0.0))


@query(f"WITH {SEQ}, a AS (SELECT min(id) AS a FROM v), b AS (SELECT id, CASE WHEN id = a THEN (a + 3) % 8 WHEN id % 3 = 1 THEN (id + 5) % 8 ELSE id % 8 END AS grp FROM v, a) SELECT x.grp AS r, y.grp AS s, count(*) AS m FROM e JOIN b x ON x.id = e.src JOIN b y ON y.id = e.dst GROUP BY 1, 2")
def sbm_commits(spark, sf_dir):
    """A move committed with its deltas, then many at once, each with its audits."""
    g = D.user_seq(spark, sf_dir)
    state, a = S.BlockState.of(g, D.blocks(g)), _first(g)
    one = state.record(spark.createDataFrame([(a, a, (a + 3) % 8)], "move_id long, id long, to long"))
    state.audit_price(one)
    state = state.commit(one).after
    state.audit()
    many = g.vertices.where((F.col("id") % 3 == 1) & (F.col("id") != a)).select(F.col("id").alias("move_id"), "id", ((F.col("id") + 5) % 8).alias("to"))
    state = state.commit(state.record(many)).after
    state.audit()
    return state.pairs.select("r", "s", "m")


@query(f"WITH {SEQ}, d AS (SELECT id AS move_id, (id + 3) % 8 AS t, id % 8 AS f FROM v), h AS (SELECT src AS id, dst % 8 AS x, true AS ahead FROM e WHERE src <> dst UNION ALL SELECT dst, src % 8, false FROM e WHERE src <> dst), l AS (SELECT src AS id FROM e WHERE src = dst), z AS (SELECT move_id, g, x, ahead, c FROM d JOIN h ON h.id = move_id, LATERAL (SELECT f AS g, -1 AS c UNION ALL SELECT t, 1) y), q AS (SELECT move_id, (CASE WHEN ahead THEN g ELSE x END) % 3 AS r, (CASE WHEN ahead THEN x ELSE g END) % 3 AS s, c FROM z UNION ALL SELECT move_id, g % 3, g % 3, c FROM d JOIN l ON l.id = move_id, LATERAL (SELECT f AS g, -1 AS c UNION ALL SELECT t, 1) y) SELECT move_id, r, s, sum(c)::BIGINT AS d FROM q GROUP BY ALL HAVING sum(c) <> 0")
def sbm_propagate(spark, sf_dir):
    """The deltas of a move of every vertex, on the next level, of three groups."""
    g = D.user_seq(spark, sf_dir)
    up = spark.range(8).select("id", (F.col("id") % 3).alias("grp"))
    return S.propagate(B.move_deltas(g, D.blocks(g), _every_move(g)), up)


@query(f"WITH {SEQ}, a AS (SELECT min(id) AS a FROM v), n AS (SELECT count(DISTINCT id % 8) AS n FROM v) SELECT round(-ln(n), 9) AS stay, round(-ln(n), 9) AS go, round(-ln(n + 1), 9) AS fresh FROM n")
def sbm_move_prob(spark, sf_dir):
    g = D.user_seq(spark, sf_dir)
    state, a = S.BlockState.of(g, D.blocks(g)), _first(g)
    return spark.createDataFrame([tuple(round(state.move_prob(a, to), 9) for to in (a % 8, (a + 1) % 8, 99))], "stay double, go double, fresh double")
