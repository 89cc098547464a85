"""PageRank, eigenvector centrality and betweenness."""

from __future__ import annotations

import zlib
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, NotDirectedError
from ..plans.superstep import Loop


def _weighted(g: Graph, weight: str | None) -> DataFrame:
    """(src, dst, w): parallel edges put together, as the sweeps are linear in the edges."""
    if g.direction == "undirected":
        raise NotDirectedError("this needs in-edges")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return g.edges.groupBy("src", "dst").agg(F.sum(w).alias("w"))


def pagerank(g: Graph, damping: float = 0.85, epsilon: float = 1e-6, max_iter: int = 0, weight: str | None = None, personalisation: DataFrame | None = None, start: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(id, rank) and the number of sweeps, until the ranks change by less than epsilon in all, or max_iter sweeps.

    personalisation: (id, p), as it is, by default 1/n each; start: (id, rank) to begin with, by default personalisation.
    A vertex whose out-edges weigh 0 in all is a sink, and what it has goes to all by personalisation.
    """
    if epsilon <= 0 and max_iter <= 0:
        raise ValueError("epsilon of 0 needs max_iter")
    n = g.num_vertices()
    spark = g.vertices.sparkSession
    loop = Loop(spark)
    if n == 0:
        return spark.createDataFrame([], "id long, rank double"), 0
    edges = _weighted(g, weight)
    out_weight = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    share = edges.join(out_weight.withColumnRenamed("id", "src"), "src").where("k <> 0").select("src", "dst", (F.col("w") / F.col("k")).alias("share"))
    share = loop.fixed(share, "share")
    base = g.vertices.select("id")
    base = base.withColumn("p", F.lit(1.0 / n)) if personalisation is None else base.join(personalisation.select("id", "p"), "id", "left").fillna(0.0, ["p"])
    base = loop.fixed(base.join(out_weight, "id", "left").select("id", "p", (F.coalesce("k", F.lit(0.0)) == 0).alias("sink")), "base")
    state = base.withColumn("rank", F.col("p"))
    if start is not None:
        state = base.join(start.select("id", F.col("rank").alias("r0")), "id", "left").withColumn("rank", F.coalesce("r0", "p")).drop("r0")
    state = loop.step(state.select("id", "p", "sink", "rank", F.lit(0.0).alias("was")))
    sweeps = 0
    while True:
        lost = state.where("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        came = state.select(F.col("id").alias("src"), "rank").join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        new = (1 - damping) * F.col("p") + damping * (F.col("p") * lost + F.coalesce("came", F.lit(0.0)))
        state = loop.step(state.join(came, "id", "left").select("id", "p", "sink", new.alias("rank"), F.col("rank").alias("was")))
        sweeps += 1
        if sweeps == max_iter or epsilon > 0 and state.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < epsilon:
            return state.select("id", "rank"), sweeps


def eigenvector(g: Graph, epsilon: float = 1e-6, max_iter: int = 0, weight: str | None = None, start: DataFrame | None = None) -> tuple[DataFrame, float, int]:
    """(id, x), the last norm and the number of sweeps of a power iteration over in-edges, from 1/n or start on."""
    if epsilon <= 0 and max_iter <= 0:
        raise ValueError("epsilon of 0 needs max_iter")
    n = g.num_vertices()
    spark = g.vertices.sparkSession
    loop = Loop(spark)
    if n == 0:
        return spark.createDataFrame([], "id long, x double"), 0.0, 0
    edges = loop.fixed(_weighted(g, weight), "edges")
    first = g.vertices.select("id", F.lit(1.0 / n).alias("x"))
    if start is not None:
        first = first.join(start.select("id", F.col("x").alias("x0")), "id", "left").select("id", F.coalesce("x0", "x").alias("x"))
    state = loop.step(first)
    sweeps = 0
    while True:
        came = state.select(F.col("id").alias("src"), "x").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("came"))
        raw = loop.step(state.join(came, "id", "left").select("id", F.col("x").alias("was"), F.coalesce("came", F.lit(0.0)).alias("y")))
        norm = raw.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
        sweeps += 1
        scaled = raw.select("id", "was", (F.col("y") / norm if norm else F.col("was")).alias("x"))
        done = sweeps == max_iter or epsilon > 0 and scaled.agg(F.sum(F.abs(F.col("x") - F.col("was")))).first()[0] < epsilon
        if done or not norm:
            return loop.step(scaled.select("id", "x")), norm, sweeps
        state = loop.step(scaled.select("id", "x"))


#: Places (a pivot and a vertex) that a task goes over at a time are six times this, and pivots at once at most WIDTH;
#: what is worked out of arcs comes in pieces of a thirty-second of it. Bounds of memory alone.
ARCS = 1 << 21
WIDTH = 128


def _spans(first, count):
    """The numbers first to first + count - 1 of each, one after the other."""
    import numpy as np

    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _pieces(count, most: int):
    """Of groups in order of their count: slices of groups of one size, and slices of at most so many of their members, with their number of each."""
    import numpy as np

    at = 0
    for size, row, rows in zip(*(x.tolist() for x in np.unique(count, return_index=True, return_counts=True))):
        step = max(1, most // max(1, size))
        for r in range(row, row + rows, step):
            k = min(step, row + rows - r)
            yield slice(r, r + k), [(slice(at + a, at + a + k * min(most, size - a)), min(most, size - a)) for a in range(0, size, most)]
            at += k * size


def _alike(begin, degree, target, pivots):
    """Pivots in an order in which those that come to the busy part of the graph after as many steps are together.

    Rows of a run are gone over where any of its pivots is, so that such runs have fewer of them; sums are the same in any order.
    """
    import numpy as np

    n = len(begin)
    if not len(target):
        return pivots
    source = np.repeat(np.arange(n), degree)
    by = np.argsort(target, kind="stable")
    back = np.searchsorted(target[by], np.arange(n + 1))
    keys = []
    for front in (np.flatnonzero(degree == degree.max())[:1], np.flatnonzero(degree > degree.mean())):
        steps, d = np.full(n, n), 0
        while len(front):
            steps[front] = d
            d += 1
            front = source[by[_spans(back[front], back[front + 1] - back[front])]]
            front = np.unique(front[steps[front] == n])
        keys.append(steps[pivots])
    return pivots[np.lexsort(keys)]


def _forced(degree, only):
    """Of vertices with one way out, only[i]: runs of them by the number of steps to the first vertex with none or a choice, nearest first; that vertex and the number for each.

    Vertices on such ways that go round are ends themselves.
    """
    import numpy as np

    n = len(degree)
    one = degree == 1
    by = np.flatnonzero(one)[np.argsort(only[one], kind="stable")]
    back = np.searchsorted(only[by], np.arange(n + 1))
    end, steps, runs = np.arange(n), np.zeros(n, np.int64), []
    front = np.flatnonzero(~one)
    while len(front):
        front = by[_spans(back[front], back[front + 1] - back[front])]
        end[front], steps[front] = end[only[front]], len(runs) + 1
        runs.append(front)
    return runs, end, steps


def _chains(begin, degree, target, times, own):
    """Of a graph whose arcs all go both ways, chains of vertices with two neighbours, from either end: end, the arcs from it on, the arcs back.

    Only those between different ends, of 4 edges or more and with several pivots: others have none that an end can stand for.
    """
    import numpy as np

    n = len(degree)
    source = np.repeat(np.arange(n), degree)
    there, back = source * n + target, target * n + source
    by, twin = np.argsort(there), np.empty(len(target), np.int64)
    twin[by] = np.argsort(back)
    if (there[by] != back[twin[by]]).any() or (times != times[twin]).any():
        return []
    two = degree == 2
    arc = np.flatnonzero((degree[source] > 2) & two[target])
    walker, found = np.arange(len(arc)), []
    while len(arc):
        found.append((walker, arc))
        on = two[target[arc]]
        walker, arc = walker[on], 2 * begin[target[arc[on]]] + 1 - twin[arc[on]]
    if not found:
        return []
    walker, arc = (np.concatenate(x) for x in zip(*found))
    arc = arc[np.argsort(walker, kind="stable")]
    ways = (x for x in np.split(arc, np.cumsum(np.bincount(walker))[:-1]))
    return [(source[x[0]], x, twin[x]) for x in ways if len(x) > 3 and degree[target[x[-1]]] > 2 and source[x[0]] != target[x[-1]] and own[target[x[:-1]]].sum() > 3]


def _aside(round_, lg, lg_ways, own, whole):
    """Of a chain's pivots those whose paths to all beyond it go by way of one end, by how many steps the other end is from it elsewhere.

    own: pivots at places 1 to length - 1; lg, lg_ways: logarithms of path counts along the chain and to the other end. Gives how
    many these are, at each place what they are not worth as targets in the end's column, and what they add to the end, to places, to
    arcs towards the end and to those away from it, by place of the arc's far end.
    """
    import numpy as np

    length = len(own) + 1
    k = 1 + np.flatnonzero(own[: (length - round_ - 1) // 2])
    many, both = own[k - 1].astype(float), round_ + length
    last, part = (both + 1) // 2 - 1 + k, np.zeros(len(k))
    if both % 2 == 0:
        meet = both // 2 + k
        part = 1 / (1 + np.exp2(np.clip(2 * lg[k] + lg_ways + lg[length] - 2 * lg[meet], -1000, 1000)))
    at = np.arange(length + 1)

    def between(first, after, x):
        return np.cumsum(np.bincount(first, x, length + 2) - np.bincount(after, x, length + 2))[: length + 1]

    zero = np.zeros_like(k)
    less = between(zero, last + 1, many) + np.bincount(last + 1, many * part, length + 1)
    beyond = whole - (last - k) - part - k
    towards = between(zero, k + 1, many * beyond) + at * between(zero, k + 1, many)
    away = between(k, last + 1, many * (last + part)) - at * between(k, last + 1, many)
    through = towards + away
    through[k] -= many * (beyond + k) + many * (last + part - k)
    return many.sum(), less[1:length], (many * beyond).sum(), through[1:length], towards[1:], away[:length]


def _dependencies(v, other, m, pivots, deal=(0, 1)):
    """Of the ids in order and of each arc (v, other), which m edges share: what depends on it, summed over the pivots.

    For each run of pivots path counts go forward by depth and dependencies back. A row is a vertex, a column a pivot, and
    a frontier the rows that any pivot has come to. Only ratios of path counts matter, and those of a depth are scaled by a
    power of two where they are large, as parallel edges make counts that no number holds. Pivots whose paths all lead to
    the same vertex first share its column, where a target is worth the number of pivots that don't pass it on the way there.
    So do those in a chain, where arcs go both ways, from which all beyond the chain is nearer by one end than by the other.
    deal: the number of this share of the columns, and of how many.
    """
    import numpy as np

    ids = np.unique(np.concatenate([v, other, pivots]))
    n = len(ids)
    order = np.argsort(v, kind="stable")
    begin = np.searchsorted(v[order], ids)
    degree = np.searchsorted(v[order], ids, side="right") - begin
    target, times = np.searchsorted(ids, other[order]), m[order].astype(float)
    through, flow = np.zeros(n), np.zeros(len(order))
    only = np.where(degree == 1, target[np.minimum(begin, len(order) - 1)], -1) if len(order) else np.full(n, -1)
    runs, end, steps = _forced(degree, only)
    own = np.bincount(np.searchsorted(ids, pivots), minlength=n)
    under, got, whole = own.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for run in reversed(runs):
        np.add.at(under, only[run], under[run])
    chains, inside = {}, np.zeros(n, bool)
    for a, to, fro in _chains(begin, degree, target, times, own):
        chains.setdefault(a, []).append((to, fro))
        inside[target[to[:-1]]] = True
    ends = np.isin(np.arange(n), list(chains))
    start = _alike(begin, degree, target, np.flatnonzero(((under > 0) & (steps == 0) & ~inside) | ends))[deal[0] :: deal[1]]
    dealt, rest = np.isin(np.arange(n), start), np.zeros(n, np.int64)
    way = np.flatnonzero(steps)
    column = np.full(n, -1)
    width = max(1, min(WIDTH, 6 * ARCS // max(n, 1)))
    most = max(1, ARCS // 32 // width)
    grows = np.bincount(target, times).max(initial=1)
    place = np.full(n, -1)

    def grouped(front, on, key=None):
        """Arcs from a frontier's rows, but for those that are not on, and the rows: together by their row or by key, groups in order of size; the groups and their sizes."""
        arc, row = _spans(begin[front], degree[front]), np.repeat(np.arange(len(front)), degree[front])
        held = on[target[arc]]
        arc, row = arc[held], row[held]
        if key is None:
            name, count = np.arange(len(front)), np.bincount(row, minlength=len(front))
        else:
            by = np.argsort(key[arc], kind="stable")
            arc, row = arc[by], row[by]
            name, count = np.unique(key[arc], return_counts=True)
        size = np.argsort(count, kind="stable")
        by = _spans((np.cumsum(count) - count)[size], count[size])
        return arc[by], row[by], name[size], count[size]

    def summed(table, arc, row, parts, ways=None):
        """Rows of a table, times the edges of their arcs, added up by group; what goes through each edge is added to flow."""
        total = 0
        for members, k in parts:
            part, edges = table.take(row[members], 0).reshape(-1, k, table.shape[1]), times[arc[members]]
            if ways is not None:
                flow[arc[members]] += np.einsum("rkw,rw->rk", part, ways).ravel()
            if (edges != 1).any():
                part *= edges.reshape(-1, k, 1)
            total = total + (part.sum(1) if k > 1 else part[:, 0])
        return total

    def runs_of():
        for first in range(0, len(start), width):
            yield start[first : first + width]
        left = _alike(begin, degree, target, np.flatnonzero(rest))
        for first in range(0, len(left), width):
            yield left[first : first + width]

    for run in runs_of():
        w = len(run)
        sigma, depth, reached = np.zeros((n, w)), np.full((n, w), -1, np.int16), np.zeros(n, np.int64)
        front, cell = np.unique(run, return_inverse=True)
        ways = np.zeros((len(front), w))
        ways[cell, np.arange(w)] = 1
        sigma[front], depth[run, np.arange(w)], reached[front] = ways, 0, np.bincount(cell)
        fronts, scales, peak = [], [], 1.0
        while len(front):
            fronts.append(front)
            scales.append(None)
            if len(fronts) == 1 << 15:
                depth = depth.astype(np.int32)
            if peak > 2.0**800:
                peak = ways.max()
                if peak > 2.0**400:
                    scales[-1] = np.ldexp(1.0, -np.frexp(ways.max(0))[1])
                    ways, peak = np.where(ways > 0, np.maximum(ways * scales[-1], 2.0**-1000), 0), 1.0
            peak *= grows
            arc, row, to, count = grouped(front, reached < w, target)
            after = np.empty((len(to), w))
            for rows, parts in _pieces(count, most):
                here, came = to[rows], summed(ways, arc, row, parts)
                was = sigma.take(here, 0)
                new = (was == 0) & (came > 0)
                came = np.multiply(came, new, out=after[rows])
                sigma[here] = np.add(was, came, out=was)
                was = depth.take(here, 0)
                was[new] = len(fronts)
                depth[here] = was
                k = np.count_nonzero(new, axis=1)
                reached[here] += k
                place[here] = k
            some = place[to] > 0
            place[to] = -1
            front, ways = (to, after) if some.all() else (to[some], after[some])
        column[run] = np.arange(w)
        share, mine = under[run].astype(float), np.where(steps > 0, column[end], -1)
        here = way[mine[way] >= 0]
        got[here], whole[run] = depth[here, mine[here]] >= 0, np.count_nonzero(depth >= 0, axis=0) - 1
        worth = [(mine, under)]
        if ends[run].any():
            worth += [(np.full(n, -1), np.zeros(n)) for _ in range(2)]
            for j, a in enumerate(run.tolist()):
                for to, fro in chains.get(a, []):
                    places, b = target[to[:-1]], target[to[-1]]
                    d = int(depth[b, j])
                    near = max(0, (len(to) - d - 1) // 2)
                    if a < b:
                        between = places[near : len(places) - near]
                        rest[between] = own[between]
                    if not own[places[:near]].any():
                        continue
                    lg_ways = np.log2(sigma[b, j]) - sum(np.log2(x[j]) for x in scales[:d] if x is not None)
                    lg = np.concatenate([[0], np.cumsum(np.log2(times[to]))])
                    many, less, at_end, at_place, towards, away = _aside(d, lg, lg_ways, own[places], int(whole[a]))
                    share[j] += many
                    through[a] += at_end
                    through[places] += at_place
                    flow[fro] += towards / times[to]
                    flow[to] += away / times[to]
                    side = worth[1 + int(a < b)]
                    side[0][places], side[1][places] = j, less
        below = np.zeros((0, w))
        for d in range(len(fronts) - 1, -1, -1):
            arc, row, name, count = grouped(fronts[d], place >= 0)
            front, after = fronts[d][name], np.empty((len(name), w))
            row = place[target[arc]]
            for rows, parts in _pieces(count, most):
                here = front[rows]
                at = depth.take(here, 0) == d
                ways = sigma.take(here, 0)
                inverse = np.divide(1.0, np.maximum(ways, 2.0**-1001))
                ways *= at
                depends = summed(below, arc, row, parts, ways)
                if d and parts:
                    through[here] += np.einsum("rw,rw->r", depends, ways)
                cells = []
                for which, less in worth:
                    ahead = np.flatnonzero(which[here] >= 0)
                    cell = ahead, which[here[ahead]]
                    cells.append((cell, inverse[cell] * (share[cell[1]] - less[here[ahead]])))
                inverse *= share
                for cell, left in cells:
                    inverse[cell] = left
                np.multiply(np.add(inverse, depends, out=inverse), at, out=after[rows])
            if d and scales[d - 1] is not None:
                after *= scales[d - 1]
            if d + 1 < len(fronts):
                place[fronts[d + 1]] = -1
            fronts[d], below = front, after
            place[front] = np.arange(len(front))
        place[:] = -1
        column[run] = -1
    # on the way to the end of a run: what is passed there, and all that is found from it but what was passed
    passed = np.zeros(n, np.int64)
    for run in runs:
        passed[run] = passed[only[run]] + got[run]
    again = own * passed
    for run in reversed(runs):
        np.add.at(again, only[run], again[run])
    through += dealt[end] * ((under - own) * (steps + whole[end]) - (again - own * passed))
    way = way[dealt[end[way]]]
    flow[begin[way]] += (under[way] * (steps[way] + whole[end[way]]) - again[way]) / times[begin[way]]
    back = np.empty(len(order))
    back[order] = flow
    return ids, through, back


def _pack(*columns):
    """Whole numbers of some columns as bytes: differences, byte by byte, which are few where rows are in order."""
    import numpy as np

    steps = np.diff(np.stack(columns).astype(np.int64), axis=1, prepend=0)
    return zlib.compress(steps.reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def _unpack(data: bytes, n: int):
    """The n columns that were packed."""
    import numpy as np

    steps = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.int64)
    return np.cumsum(steps.reshape(n, -1), axis=1)


def _packed(batches):
    """Arcs (v, other, m), a row for each batch."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch([pa.array([_pack(*(batch[c].to_numpy() for c in ("v", "other", "m")))], pa.binary())], ["arcs"])


#: Sums that go as a row from a task to where they are added up.
CHUNK = 1 << 14


def _of_pivots(batches, both: bool, tasks: int = 0):
    """Packed arcs and, without any, pivots v; to the sums over these pivots in chunks (chunk, ends, part).

    Sums are of vertices, as (v, v), and of arcs in order, in every task alike, so that the first one's ends do for all.
    With both, an arc is passed either way, and its sum is of the two. With tasks, each has all pivots and goes over its share.
    """
    import numpy as np
    import pyarrow as pa

    batches = [x for x in batches if x.num_rows]
    packed = [_unpack(x.as_py(), 3) for batch in batches for x in batch["arcs"].drop_null()]
    if not packed:
        return
    pivots = np.concatenate([batch["v"].drop_null().to_numpy() for batch in batches])
    block = batches[0]["block"][0].as_py()
    head, deal = block == 0, (block, tasks) if tasks else (0, 1)
    if not (head or len(pivots)):
        return
    v, other, m = np.concatenate(packed, axis=1)
    order = np.lexsort((other, v))
    v, other, m = v[order], other[order], m[order]
    del packed, order
    if both:
        ids, through, flow = _dependencies(np.concatenate([v, other]), np.concatenate([other, v]), np.concatenate([m, m]), pivots, deal)
        flow = flow[: len(v)] + flow[len(v) :]
    else:
        ids, through, flow = _dependencies(v, other, m, pivots, deal)
    ends = np.unique(np.concatenate([v, other]))
    part = np.concatenate([through[np.searchsorted(ids, ends)], flow])
    v, other = np.concatenate([ends, v]), np.concatenate([ends, other])
    for first in range(0, len(part), CHUNK):
        run = slice(first, first + CHUNK)
        if head or part[run].any():
            yield pa.record_batch([pa.array([first // CHUNK]), pa.array([_pack(v[run], other[run]) if head else None], pa.binary()), pa.array([part[run].tobytes()], pa.binary())], ["chunk", "ends", "part"])


def _added(rows):
    """The sums (v, other, part) of a chunk over all tasks."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    v, other = _unpack(rows["ends"].drop_null()[0].as_py(), 2)
    part = sum(np.frombuffer(x.as_py()) for x in rows["part"])
    out = pa.table({"v": v, "other": other, "part": part})
    return out.filter(pc.not_equal(out["part"], 0.0))


def betweenness(g: Graph, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, betweenness) of vertices and (edge_id, betweenness) of edges, unnormalised, from all sources or those given.

    Pivots are dealt to the cores; each task holds all arcs, some 150 bytes for each, and sums up over its pivots, so that
    nothing is written for a pair of pivot and vertex or edge. Tasks get the arcs packed, of undirected views each once, and
    all pivots, as which can go together is seen in the graph alone, and give 8 bytes for each sum. Parallel edges are different paths, loops none; on undirected views both are halved.
    """
    spark = g.vertices.sparkSession
    loop = Loop(spark)
    both = g.direction == "undirected"
    half = 0.5 if both else 1.0
    v, other = (F.least("src", "dst"), F.greatest("src", "dst")) if both else (F.col("src"), F.col("dst"))
    ends = loop.fixed(g.edges.select("edge_id", v.alias("v"), other.alias("other")), "ends")
    n = spark.sparkContext.defaultParallelism
    arcs = ends.where("v <> other").groupBy("v", "other").agg(F.count(F.lit(1)).alias("m")).sortWithinPartitions("v", "other").mapInArrow(_packed, "arcs binary")
    arcs = arcs.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), "arcs", F.lit(None).cast("long").alias("v"))
    pivots = (g.vertices if sources is None else sources).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(None).cast("binary").alias("arcs"), F.col("id").alias("v"))
    found = arcs.unionByName(pivots).repartitionById(n, F.col("block")).mapInArrow(partial(_of_pivots, both=both, tasks=n), "chunk long, ends binary, part binary")
    found = loop.fixed(found.groupBy("chunk").applyInArrow(_added, "v long, other long, part double"), "found").withColumn("part", F.col("part") * half)
    vertex = found.where("v = other").select(F.col("v").alias("id"), F.col("part").alias("betweenness"))
    vertex = g.vertices.select("id").join(vertex, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
    edge = ends.join(found.where("v <> other"), ["v", "other"], "left").select("edge_id", F.coalesce("part", F.lit(0.0)).alias("betweenness"))
    return vertex, edge
