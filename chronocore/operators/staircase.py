"""Core numbers at one time scale, and the staircase of core numbers over all scales from ``floor`` to ``dmax``.

An edge's window at scale d, at one of its ends, holds the edges there whose time differs by d at most. The core number
c_d is the largest k such that the edge is in a set of edges each of which sees k of the set in both windows. It is the
greatest fixpoint of a downward iteration, so any order of local updates from an upper bound ends at it.

Every window lies within d of the edge's time. So time is cut into slabs that are wider than ``dmax``: a task solves one
slab to a local fixpoint at all scales with copies of the edges beyond its ends held at their last staircase. Levels are
solved upward and scales downward, on the edges that are still alive at that level and scale alone; the next scale is the
largest that takes an edge away. Rounds go on over the slabs next to a change until nothing changes. Every other round the
slabs are moved by half their width, so that what was near an end is in the middle; edges of core 1 at ``dmax`` are done.

If ``dmax`` is so large that a slab would hold more than ``SLAB_EDGES`` edges, each scale is solved by relational
peeling instead, in which no group of rows has to meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronocore.functions.columns import slab
from chronocore.operators.edges import critical_radii, sides
from chronocore.plans.storage import dealt, stored

#: Edges that a task may hold, copies included, and edges that a slab is meant to hold.
SLAB_EDGES, TARGET = 2_000_000, 100_000
#: Steps, edges times scales at most, that a task may hold.
CELLS = 1 << 26
TOP = 2**31 - 1
#: Levels up to which sides that go are taken out of a linked list.
LINKED = 6
MOST_ROUNDS = 10_000
#: Tables that the index may be read from.
FEW = 8
_STATE = "e long, u long, v long, t long, deltas array<long>, values array<int>, changed boolean"


def local_windows(u: np.ndarray, v: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edge, vertex run start, vertex run end, time) of all sides in the order of (vertex, time)."""
    x, edge = np.concatenate([u, v]), np.tile(np.arange(len(t)), 2)
    order = np.lexsort((edge, t[edge], x))
    x, edge = x[order], edge[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return edge, first[run], np.append(first[1:], len(x))[run], t[edge]


class Sides:
    """Sides in order, with the bounds of each one's window at a scale."""

    def __init__(self, u: np.ndarray, v: np.ndarray, t: np.ndarray):
        self.edge, self.low, self.high, self.t = local_windows(u, v, t)
        # Times by vertex on one axis: runs are set apart by more than any window.
        base = int(t.min()) if len(t) else 0
        self.span = int(t.max()) - base + 1 if len(t) else 1
        run = np.cumsum(np.concatenate([[0], (self.low[1:] != self.low[:-1])])) if len(self.low) else np.zeros(0, int)
        self.run, self.rel = run.astype(np.int64), (self.t - base).astype(np.int64)

    def bounds(self, delta: int) -> tuple[np.ndarray, np.ndarray]:
        reach = min(int(delta), self.span)
        gap = self.span + reach + 1
        axis = self.run * gap + self.rel
        return np.searchsorted(axis, axis - reach, "left"), np.searchsorted(axis, axis + reach, "right")


def peel(sides_: Sides, delta: int, bound: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Core numbers at ``delta`` of the edges ``own``, none over ``bound``; other edges stay at their bound.

    Level by level, edges whose window is too small are taken away until none is; counts are sums over alive sides.
    """
    lo, hi = sides_.bounds(delta)
    edge = sides_.edge
    core = np.where(own, 1, bound).astype(np.int64)
    m = len(bound)
    alive = bound >= 2
    level = 2
    while (alive & own).any():
        while True:
            total = np.concatenate([[0], np.cumsum(alive[edge])])
            short = total[hi] - total[lo] < level
            dead = np.zeros(m, bool)
            dead[edge[short]] = True
            dead &= alive & own
            if not dead.any():
                break
            alive &= ~dead
        core[alive & own] = level
        level += 1
        alive = alive & (bound >= level)
    return core


def reach(axis: np.ndarray, k: int) -> np.ndarray:
    """For each place of the ascending ``axis`` the least distance within which there are ``k`` places, its own included.

    Of the ways to have j of them before it the distance back grows with j and the one ahead falls, so the best is where they meet.
    """
    far = np.iinfo(np.int64).max // 4
    padded = np.concatenate([np.full(k - 1, -far), axis, np.full(k - 1, far)])
    at = np.arange(k - 1, k - 1 + len(axis))
    if k == 2:
        step = np.diff(padded)
        return np.minimum(step[:-1], step[1:])
    low, high = np.zeros(len(axis), np.int64), np.full(len(axis), k - 1)
    while (low < high).any():
        j = (low + high) // 2
        enough = axis - padded[at - j] >= padded[at + k - 1 - j] - axis
        low, high = np.where(enough, low, j + 1), np.where(enough, j, high)
    back = np.maximum(axis - padded[at - low], padded[at + k - 1 - low] - axis)
    less = np.maximum(low - 1, 0)
    return np.minimum(back, np.maximum(axis - padded[at - less], padded[at + k - 1 - less] - axis))


def local_axis(x: np.ndarray, t: np.ndarray, dmax: int) -> np.ndarray:
    """Places of sides in the order of (vertex, time): distances up to ``dmax`` at a vertex are kept, all others are larger."""
    step = np.zeros(len(t), np.int64)
    step[1:] = np.where(x[1:] == x[:-1], np.minimum(t[1:] - t[:-1], dmax + 1), dmax + 1)
    return np.cumsum(step)


def onsets(edge: np.ndarray, axis: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, floor: int, dmax: int) -> np.ndarray:
    """The least scale at which each edge's core number is ``k`` or more, ``dmax`` + 1 if it never is; none under ``bound``.

    ``edge`` and ``axis`` are the sides of the edges whose bound is at most ``dmax``; edges not ``own`` stay at theirs.
    """
    out, d = bound.copy(), dmax
    while len(edge):
        need = reach(axis, k)
        dead = (need > d) & own[edge] | (bound[edge] > d)
        if d == dmax and k <= LINKED and dead.sum() * 8 < len(edge):
            return _unlinked(edge, axis, need, own, out, k, floor, dmax)
        if dead.any():
            gone = edge[dead]
            out[gone] = np.where(own[gone], d + 1, out[gone])
            alive = np.ones(len(own), bool)
            alive[gone] = False
            left = alive[edge]
            edge, axis = edge[left], axis[left]
            continue
        mine = own[edge]
        if not mine.any():
            break
        # Every scale down to the largest need or bound takes nothing away.
        least = max(int(need[mine].max()), int(bound[edge].max()))
        if least <= floor:
            out[edge[mine]] = floor
            break
        d = least - 1
    return out


def _unlinked(edge: np.ndarray, axis: np.ndarray, need: np.ndarray, own: np.ndarray, out: np.ndarray, k: int, floor: int, dmax: int) -> np.ndarray:
    """onsets() over a linked list of sides: only what is near a side that goes is looked at again."""
    n, far = len(edge), np.iinfo(np.int64).max // 4
    axis = np.concatenate([[-far], axis, [far]])
    # Places count from 1; those before the first and after the last lead to themselves.
    before, after = np.maximum(np.arange(n + 2) - 1, 0), np.minimum(np.arange(n + 2) + 1, n + 1)
    alive = np.ones(n + 2, bool)
    mine = np.concatenate([[False], own[edge], [False]])
    # An edge goes below this scale; of a bound edge that is not its own, the bound.
    least = np.concatenate([[0], out[edge], [0]])
    least[mine] = np.maximum(least[1:-1], need)[mine[1:-1]]
    pairs = np.argsort(edge, kind="stable").reshape(-1, 2) + 1
    sides_ = np.zeros((len(own), 2), np.int64)
    sides_[edge[pairs[:, 0] - 1]] = pairs
    start = out.copy()
    live, d = np.arange(1, n + 1), dmax
    dead = live[least[live] > d]
    while True:
        while len(dead):
            gone = np.unique(edge[dead - 1])
            out[gone] = np.where(own[gone], d + 1, out[gone])
            p = sides_[gone].ravel()
            alive[p] = False
            for to in (before, after):
                while True:
                    q = to[p]
                    through = ~alive[q]
                    if not through.any():
                        break
                    to[p[through]] = to[q[through]]
            left, right = before[p], after[p]
            after[left], before[right] = right, left
            near = [left, right]
            for _ in range(k - 2):
                left, right = before[left], after[right]
                near += [left, right]
            near = np.unique(np.concatenate(near))
            near = near[mine[near]]
            back, ahead = [near], [near]
            for _ in range(k - 1):
                back.append(before[back[-1]])
                ahead.append(after[ahead[-1]])
            at, best = axis[near], np.full(len(near), far)
            for j in range(k):
                np.minimum(best, np.maximum(at - axis[back[j]], axis[ahead[k - 1 - j]] - at), out=best)
            least[near] = np.maximum(best, start[edge[near - 1]])
            dead = near[least[near] > d]
        live = live[alive[live]]
        kept = live[mine[live]]
        if not len(kept):
            return out
        # Every scale down to the largest of these takes nothing away.
        most = int(least[live].max())
        if most <= floor:
            out[edge[kept - 1]] = floor
            return out
        d = most - 1
        dead = live[least[live] > d]


def _solver(floor: int, dmax: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        here = key[1].as_py()
        table = table.combine_chunks()
        u, v, t = (table.column(c).to_numpy() for c in "uvt")
        own = table.column("home").to_numpy() == here
        if "start" in table.column_names:  # one step each
            cuts, steps, values = np.arange(len(t) + 1), np.full(len(t), floor, np.int64), table.column("start").to_numpy()
        else:
            steps, values = (table.column(c).combine_chunks() for c in ("deltas", "values"))
            cuts = steps.offsets.to_numpy().astype(np.int64)
            steps, values = steps.flatten().to_numpy(), values.flatten().to_numpy()
            cuts = cuts - cuts[0]
        of = np.repeat(np.arange(len(t), dtype=np.int32), np.diff(cuts))
        before = np.concatenate([[0], values[:-1]]) if len(values) else values
        before[cuts[:-1]] = 0
        x, edge = np.concatenate([u, v]), np.tile(np.arange(len(t), dtype=np.int32), 2)
        order = np.lexsort((t[edge], x))
        edge = edge[order]
        axis = local_axis(x[order], t[edge], dmax)
        del x, order
        found_e, found_d, found_k = [np.flatnonzero(own)], [np.full(int(own.sum()), floor, np.int64)], [np.ones(int(own.sum()), np.int32)]
        changed, last, k = values[cuts[:-1]] == TOP, np.full(len(t), floor, np.int64), 2
        while True:
            bound = np.full(len(t), dmax + 1, np.int64)
            at = (values >= k) & (before < k)
            bound[of[at]] = steps[at]
            new = np.where(own, np.maximum(bound, last), bound)
            some = new[edge] <= dmax
            edge, axis = edge[some], axis[some]
            if not own[edge].any():
                changed |= own & (bound <= dmax)
                break
            last = onsets(edge, axis, own, new, k, floor, dmax)
            changed |= own & (last != bound)
            reached = np.flatnonzero(own & (last <= dmax))
            found_e.append(reached)
            found_d.append(last[reached])
            found_k.append(np.full(len(reached), k, np.int32))
            k += 1
        e, d, c = (np.concatenate(y) for y in (found_e, found_d, found_k))
        order = np.argsort(e, kind="stable")
        e, d, c = e[order], d[order], c[order]
        # Of levels reached at one scale the highest is its value.
        kept = np.ones(len(e), bool)
        kept[:-1] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
        e, d, c = e[kept], d[kept], c[kept]
        mine = np.flatnonzero(own)
        ends = pa.array(np.append(np.searchsorted(e, mine), len(e)).astype(np.int32))
        rows = table.take(pa.array(mine))
        return pa.table({
            **{c_: rows.column(c_) for c_ in "euvt"}, "deltas": pa.ListArray.from_arrays(ends, pa.array(d)),
            "values": pa.ListArray.from_arrays(ends, pa.array(c)), "changed": pa.array(changed[mine]),
        })

    return run


def slab_width(edges: DataFrame, dmax: int, target: int = TARGET, most: int = SLAB_EDGES) -> int:
    """At least four times ``dmax``, and so wide that a slab has about ``target`` edges; down to ``dmax`` where a slab would hold over ``most`` with its copies."""
    row = edges.agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).first()
    if not row["n"]:
        return 1
    span = row["b"] - row["a"] + 1
    room = span * most * 3 // (4 * row["n"]) - 2 * dmax
    return max(1, dmax, min(max(4 * dmax, span * target // row["n"]), room))


def fits(edges: DataFrame, dmax: int, width: int, most: int = SLAB_EDGES) -> bool:
    """Whether no slab, with its copies, has more than ``most`` edges."""
    t = F.col("t")
    homes = edges.select(F.explode(F.sequence(slab(t - dmax, width), slab(t + dmax, width))).alias("slab"))
    largest = homes.groupBy("slab").count().agg(F.max("count")).first()[0]
    return largest is None or largest <= most


def staircases(edges: DataFrame, floor: int, dmax: int | None = None, width: int | None = None, most: int = SLAB_EDGES) -> DataFrame:
    """(e, deltas, values) of every edge, stored: ascending scales from ``floor`` on, and the core number from each on.

    Without ``dmax`` scales go up to the time span, and the core numbers without a time scale are the bounds to start from.
    """
    if not 0 <= floor <= (floor if dmax is None else dmax):
        raise ValueError("0 <= floor <= dmax must hold")
    edges = edges.select("e", "u", "v", "t")
    start = None
    if dmax is None:
        dmax = max(edges.agg(F.max("t") - F.min("t")).first()[0] or 0, floor)
        start = stored(static_core(edges).withColumnRenamed("c", "start"))
    given, room = width is not None, min(most, CELLS // (dmax - floor + 1))
    width = width or slab_width(edges, dmax)
    first, last = edges.agg(F.coalesce(F.min("t"), F.lit(0)), F.coalesce(F.max("t"), F.lit(0))).first()
    if not fits(edges, dmax, width, room):
        return _by_scale(edges, floor, dmax)
    t = F.col("t")
    state = edges.withColumn("start", F.lit(TOP)) if start is None else edges.join(start, "e")
    active, done = None, []
    for turn in range(MOST_ROUNDS):
        # The ends of slabs in this round.
        move = turn % 2 * (width // 2)
        near = F.sequence(slab(t - dmax + move, width), slab(t + dmax + move, width))
        copies = state.select("e", "u", "v", "t", *(["deltas", "values"] if turn else ["start"]), slab(t + move, width).alias("home"), F.explode(near).alias("slab"))
        if active is not None:
            copies = copies.join(active, "slab", "left_semi")
        solved = dealt(copies, F.col("slab"), (last - first) // width + 2, "slab").applyInArrow(_solver(floor, dmax), _STATE)
        if active is not None:  # slabs without a change beside them stay as they are
            rest = state.withColumn("slab", slab(t + move, width)).join(active, "slab", "left_anti")
            solved = solved.unionByName(rest.select("e", "u", "v", "t", "deltas", "values", F.lit(False).alias("changed")))
        solved = stored(solved)
        # Nothing falls below 1, and an edge of core 1 counts at no other level.
        over = F.element_at("values", -1) > 1
        wider = width
        if not turn and not given:  # many edges are done by now: what is left has room in wider slabs, which need fewer rounds
            living = solved.filter(over)
            wider = max(width, slab_width(living, dmax))
            wider = wider if fits(living, dmax, wider, room) else width
        then = (turn + 1) % 2 * (wider // 2)
        ends = solved.filter("changed").select("t").distinct().select(F.explode(F.array(t - dmax, t + dmax)).alias("at"), slab(t + move, width).alias("home"), "t")
        beside = ends.filter(slab(F.col("at") + move, width) != F.col("home"))
        beside = beside.select(F.explode(F.sequence(slab(t - dmax + then, wider), slab(t + dmax + then, wider))).alias("slab")).distinct()
        active = stored(beside)
        done.append(solved.filter(~over).select("e", "deltas", "values"))
        state, width = solved.filter(over).drop("changed"), wider
        if active.isEmpty():
            out = state.select("e", "deltas", "values")
            for some in done:
                out = out.unionByName(some)
            return stored(out) if len(done) > FEW else out
    raise RuntimeError("core numbers did not settle")  # pragma: no cover


def _by_scale(edges: DataFrame, floor: int, dmax: int) -> DataFrame:
    """One relational peel for each critical radius, downward; each starts from the one above it."""
    radii = [floor, *(r["delta"] for r in critical_radii(edges, floor, dmax).orderBy("delta").toLocalIterator())]
    out, above = None, None
    for d in reversed(radii):
        above = relational_core(edges, d, above)
        rows = above.select("e", F.lit(d).alias("delta"), F.col("c").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    steps = out.groupBy("e", "value").agg(F.min("delta").alias("delta"))
    steps = steps.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("delta", "value"))).alias("steps"))
    return stored(steps.select("e", F.col("steps.delta").cast("array<long>").alias("deltas"), F.col("steps.value").cast("array<int>").alias("values")))


def relational_core(edges: DataFrame, delta: int, bound: DataFrame | None = None) -> DataFrame:
    """(e, c) at one scale by peeling with windowed counts over (vertex, slab); ``bound`` (e, c) is an upper bound. Stored."""
    from chronocore.operators.edges import window_degrees

    edges = edges.select("e", "u", "v", "t")
    core = stored(edges.select("e", F.lit(1).alias("c")))
    alive, level = stored(edges), 2
    while True:
        if bound is not None:
            alive = alive.join(bound.filter(F.col("c") >= level).select("e"), "e", "left_semi")
        n = -1
        alive = stored(alive)
        while (left := alive.count()) != n and left:
            n = left
            alive = stored(alive.join(window_degrees(alive, delta).filter(F.col("degree") >= level).select("e"), "e", "left_semi"))
        if not left:
            return core
        core = stored(core.join(alive.select("e", F.lit(level).alias("up")), "e", "left").select("e", F.coalesce("up", "c").alias("c")))
        level += 1


def core_numbers(edges: DataFrame, delta: int, width: int | None = None) -> DataFrame:
    """(e, c) of every edge at one scale."""
    return staircases(edges, delta, delta, width).select("e", F.col("values")[0].alias("c"))


def static_core(edges: DataFrame, most: int = SLAB_EDGES) -> DataFrame:
    """(e, c) without a time scale: the lesser of the core numbers of the edge's two vertices, parallel edges counted.

    Graphs of at most ``most`` edges are peeled in one task; larger ones by degree counts, summed in each task before
    the shuffle.
    """
    edges = stored(edges.select("e", "u", "v", "t"))
    if edges.count() > most:
        return _peeled(edges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Sides(*(pdf[c].to_numpy(np.int64) for c in "uvt"))
        c = peel(s, s.span, np.full(len(pdf), TOP, np.int64), np.ones(len(pdf), bool))
        return pd.DataFrame({"e": pdf["e"], "c": c.astype(np.int32)})

    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "e long, c int")


def _peeled(edges: DataFrame) -> DataFrame:
    core = stored(edges.select("e", F.lit(1).alias("c")))
    alive, level = stored(edges), 2
    while True:
        n = -1
        while (left := alive.count()) != n and left:
            n = left
            low = sides(alive).groupBy("x").count().filter(F.col("count") < level).select("x")
            low = stored(low)
            alive = stored(alive.join(low, alive["u"] == low["x"], "left_anti").join(low, alive["v"] == low["x"], "left_anti"))
        if not left:
            return core
        core = stored(core.join(alive.select("e", F.lit(level).alias("up")), "e", "left").select("e", F.coalesce("up", "c").alias("c")))
        level += 1
