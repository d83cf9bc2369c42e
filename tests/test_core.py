"""Core numbers, the index and its queries against a golden table and a plain peel on random multigraphs."""

import random

import pytest
from pyspark.sql import functions as F

from chronocore.operators import communities, edges, forest, index, merges, staircase, sweep
from chronocore.plans.storage import dealt, stored

# Golden table: lines, and by edge (base, steps, area over 0 .. 8).
LINES = [(10, 20, 0), (20, 30, 1), (30, 10, 2), (10, 20, 2), (20, 10, 5), (30, 40, 9), (40, 30, 9), (7, 7, 3), (30, 20, 6)]
EDGES = [(0, 0, 1, 0), (1, 1, 2, 1), (2, 0, 1, 2), (3, 0, 2, 2), (4, 0, 1, 5), (5, 1, 2, 6), (6, 2, 3, 9)]
STEPS = [([0, 2, 5], [1, 2, 3]), ([0, 1, 5], [1, 2, 3]), ([0, 1, 5], [1, 2, 3]), ([0, 1, 5], [1, 2, 3]), ([0, 3, 5], [1, 2, 3]), ([0, 4, 5], [1, 2, 3]), ([0], [1])]
AREAS = [20, 21, 21, 21, 19, 18, 9]
MERGES = {
    1: [(2, 3), (0, 1), (1, 2), (4, 5), (2, 4), (5, 6)],
    2: [(1, 2), (1, 3), (0, 1), (2, 4), (3, 5)],
    3: [(0, 1), (0, 2), (1, 3), (2, 4), (3, 5)],
}


def rows(df):
    return sorted(map(tuple, df.collect()))


def plain_core(graph, delta):
    """Peel by level; graph: (e, u, v, t)."""
    core, level, alive = {e: 1 for e, *_ in graph}, 2, list(graph)
    while alive:
        while True:
            seen = lambda x, t: sum(x in f[1:3] and abs(f[3] - t) <= delta for f in alive)  # noqa: E731, B023
            left = [f for f in alive if min(seen(f[1], f[3]), seen(f[2], f[3])) >= level]
            if len(left) == len(alive):
                break
            alive = left
        for f in alive:
            core[f[0]] = level
        level += 1
    return core


def plain_communities(graph, some, delta):
    up = {e: e for e in some}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in graph:
        for b in graph:
            if a[0] in up and b[0] in up and {a[1], a[2]} & {b[1], b[2]} and abs(a[3] - b[3]) <= delta:
                up[max(root(a[0]), root(b[0]))] = min(root(a[0]), root(b[0]))
    return {e: root(e) for e in some}


def random_graph(seed, m=40, nodes=6, span=20):
    r = random.Random(seed)
    found = {(t, u, v) for u, v, t in ((r.randrange(nodes), r.randrange(nodes), r.randrange(span)) for _ in range(m)) if u < v}
    return [(i, u, v, t) for i, (t, u, v) in enumerate(sorted(found))]


@pytest.fixture(scope="module")
def golden(spark):
    lines = spark.createDataFrame([(i, *x) for i, x in enumerate(LINES)], "line long, u long, v long, t long")
    g = stored(edges.interned(lines))
    return g, stored(staircase.staircases(g, 0, 9))


def test_golden_index(spark, golden):
    g, ix = golden
    assert rows(g) == EDGES
    assert rows(ix) == [(e, *s) for e, s in enumerate(STEPS)]
    queries = spark.createDataFrame([(e, 0, 9) for e in range(7)], "e long, a long, b long")
    assert [int(a) for *_, a in rows(index.area(ix, queries))] == AREAS


def test_golden_merges_and_forest(spark, golden):
    g, ix = golden
    level = stored(index.levels(ix))
    for target in (1, 3, merges.TARGET):
        found = merges.merges(merges.candidates(g, level, target))
        for k, pairs in MERGES.items():
            assert [(r.a, r.b) for r in sorted(found.filter(F.col("k") == k).collect(), key=lambda r: (r.w, r.a, r.b))] == pairs
    assert rows(merges.merges(merges.candidates(g, level), most=0)) == rows(found)
    nodes, leaves = forest.build(found, level)
    assert sorted(r.pos for r in leaves.filter("k = 1").collect()) == list(range(7))
    for k, delta, e, members in ((1, 0, 2, [2, 3]), (2, 1, 3, [1, 2, 3]), (2, 2, 0, [0, 1, 2, 3]), (3, 5, 5, [0, 1, 2, 3, 4, 5]), (3, 4, 0, [])):
        assert [r[0] for r in rows(forest.community_of(nodes, leaves, k, delta, e))] == members
        assert [r[0] for r in rows(communities.community_of(g, ix, k, delta, e))] == members
        assert [r[0] for r in rows(merges.community_of(merges.distinct_pairs(found), g, ix, k, delta, e))] == members


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs_against_plain_peel(spark, seed):
    graph = random_graph(seed)
    g = stored(spark.createDataFrame(graph, "e long, u long, v long, t long"))
    dmax = 8
    ix = stored(staircase.staircases(g, 0, dmax, width=5 + seed))
    at = {d: dict(rows(index.snapshot(ix, d, 0, dmax))) for d in range(dmax + 1)}
    assert at == {d: plain_core(graph, d) for d in range(dmax + 1)}
    assert rows(staircase._by_scale(g, 0, dmax)) == rows(ix)
    big = plain_core(graph, 10**6)
    kappa = dict(rows(staircase.static_core(g)))
    assert kappa == dict(rows(staircase.static_core(g, most=0)))
    assert all(kappa[e] >= big[e] for e in big)
    merged = merges.build(g, ix)
    u = stored(merges.distinct_pairs(merged))
    for k, d in ((1, 2), (2, 4), (3, 8)):
        some = {e for e, c in at[d].items() if c >= k}
        truth = sorted(plain_communities(graph, some, d).items())
        assert rows(communities.communities(g, ix, k, d)) == truth
        assert rows(merges.communities(u, g, ix, k, d)) == truth


def test_whole_span_and_large_steps(spark, monkeypatch):
    graph = random_graph(7, m=30, nodes=5, span=12)
    g = stored(spark.createDataFrame(graph, "e long, u long, v long, t long"))
    span = max(t for *_, t in graph) - min(t for *_, t in graph)
    ix = stored(staircase.staircases(g, 0))
    for d in (0, 1, 4, span):
        assert dict(rows(index.snapshot(ix, d, 0, span))) == plain_core(graph, d)
    assert rows(staircase.staircases(g.limit(0), 0)) == []
    monkeypatch.setattr(staircase, "CELLS", 20)  # too many scales for a task
    assert rows(staircase.staircases(g, 0, 3)) == rows(staircase._by_scale(g, 0, 3))
    from chronocore.functions.columns import slab

    big = 2**62 + 1
    df = spark.createDataFrame([(t,) for t in (-7, -5, 0, 4, 5, big)], "t long")
    assert [r[0] for r in df.select(slab(F.col("t"), 5)).collect()] == [t // 5 for t in (-7, -5, 0, 4, 5, big)]


def test_queries_and_their_bounds(spark, golden):
    _, ix = golden
    q = spark.createDataFrame([(0, 0), (0, 4), (0, 9), (0, 10), (6, -1), (99, 1)], "e long, delta long")
    assert {(r.e, r.delta): r.c for r in index.point(ix, q, 0, 9).collect()} == {(0, 0): 1, (0, 4): 2, (0, 9): 3, (0, 10): None, (6, -1): None}
    with pytest.raises(Exception, match="scale outside"):
        index.point(ix, q, 0, 9, strict=True).collect()
    q = spark.createDataFrame([(0, 1), (0, 3), (0, 4), (6, 2)], "e long, k int")
    assert {(r.e, r.k): r.delta for r in index.onset(ix, q).collect()} == {(0, 1): 0, (0, 3): 5, (0, 4): None, (6, 2): None}
    with pytest.raises(ValueError, match="scale outside"):
        index.snapshot(ix, 10, 0, 9)
    with pytest.raises(ValueError, match="floor"):
        staircase.staircases(ix, 3, 2)
    assert sweep.point_batch(ix, 100, 0, 9).filter("c is null").isEmpty()
    assert sweep.grid_levels(1) == [1] and sweep.grid_levels(11) == [1, 3, 5, 7, 9, 11]


def test_drops_round_trip_and_faults(spark, golden):
    _, ix = golden
    seed, log = index.directory(ix).select("e", "top"), stored(index.drops(ix))
    assert rows(index.from_drops(seed, log, 0)) == rows(ix)
    assert index.drop_faults(seed, log, 0, 9).isEmpty()
    bad = spark.createDataFrame([(4, 0, 2), (4, 0, 1), (9, 1, 1), (2, 2, 3), (1, 77, 1)], "delta_below long, e long, value_below int")
    assert {(r.e, r.fault) for r in index.drop_faults(seed, bad, 0, 9).collect()} >= {(0, "repeat"), (1, "scale"), (2, "value"), (77, "unknown edge")}


def test_windows_and_radii(spark, golden):
    g, _ = golden
    graph = EDGES
    for d in (0, 2, 5):
        seen = lambda x, t: sum(x in f[1:3] and abs(f[3] - t) <= d for f in graph)  # noqa: E731, B023
        assert dict(rows(edges.window_degrees(g, d))) == {e: min(seen(u, t), seen(v, t)) for e, u, v, t in graph}
    gaps = {abs(a[3] - b[3]) for a in graph for b in graph if {a[1], a[2]} & {b[1], b[2]}}
    assert {r[0] for r in rows(edges.critical_radii(g, 0, 9))} == {x for x in gaps if 0 < x <= 9}
    assert tuple(edges.statistics(g).first()) == (7, 9, 4, 5, 8)


def test_empty_and_level_spans(spark, golden):
    g, ix = golden
    none = stored(g.limit(0))
    assert rows(staircase.staircases(none, 0, 3)) == []
    assert rows(merges.build(none, ix)) == []
    assert tuple(merges.level_spans(merges.build(g, ix)).first())[:3] == (16, 9, 9)


def test_columns(spark):
    from chronocore.functions.columns import MOST, h_index, scaled, window

    df = spark.createDataFrame([([5, 4, 3, 1], 7, 10), ([], MOST, 3), ([1, 1], 2, MOST)], "a array<int>, t long, d long")
    assert [r[0] for r in df.select(h_index(F.col("a"))).collect()] == [3, 0, 1]
    lo, hi = window(F.col("t"), F.col("d"))
    assert rows(df.select(lo, hi)) == sorted([(0, 17), (MOST - 3, MOST), (0, MOST)])
    assert [r[0] for r in df.select(scaled(F.col("t"), 3, 4)).collect()] == [5, MOST * 3 // 4, 1]


def test_times_near_the_largest_number(spark):
    late = 2**63 - 20
    g = spark.createDataFrame([(u, v, t + late) for _, u, v, t in EDGES], "u long, v long, t long")
    found = stored(edges.canonical(edges.rebased(g)))
    assert rows(found) == EDGES
    assert rows(staircase.staircases(found, 0, 9)) == [(e, *s) for e, s in enumerate(STEPS)]


def test_star_and_one_time(spark):
    star = spark.createDataFrame([(0, i, i % 7) for i in range(1, 200)], "u long, v long, t long")
    g = stored(edges.canonical(star))
    assert {r.c for r in staircase.core_numbers(g, 3).collect()} == {1}
    assert edges.window_degrees(g, 6).agg(F.max("degree")).first()[0] == 1
    same = stored(edges.canonical(spark.createDataFrame([(a, b, 5) for a in range(5) for b in range(a)] + [(3, 3, 5)], "u long, v long, t long")))
    assert rows(staircase.staircases(same, 0, 0)) == [(e, [0], [4]) for e in range(10)]


def test_distances_and_onsets_against_plain():
    """Each place's least distance that holds k places, in runs of a vertex; gaps over dmax count as larger."""
    import numpy as np

    r = random.Random(12)
    for _ in range(300):
        n, dmax = r.randint(1, 30), r.randint(0, 9)
        ends = sorted((r.randrange(4), r.randrange(25)) for _ in range(n))
        axis = staircase.local_axis(*(np.array(c, np.int64) for c in zip(*ends, strict=True)), dmax)
        for k in (2, 3, 4, 7):
            found = staircase.reach(axis, k)
            for i, (x, t) in enumerate(ends):
                near = sorted(abs(s - t) for y, s in ends if y == x)
                truth = near[k - 1] if len(near) >= k else dmax + 1
                assert found[i] == truth if truth <= dmax else found[i] > dmax


def test_dense_times_keep_their_slabs(spark):
    """Slabs get narrower than four times dmax, where they would hold too many edges, before scales are peeled one by one."""
    g = stored(spark.range(4000).selectExpr("id AS e", "id % 50 AS u", "1000 + id % 77 AS v", "id % 200 AS t"))
    width = staircase.slab_width(g, 10, most=1000)
    assert 10 <= width < 40 and staircase.fits(g, 10, width, 1000) and staircase.slab_width(g, 10) >= 40
    assert rows(staircase.staircases(g, 0, 10, width, most=1000)) == rows(staircase.staircases(g, 0, 10, 200))


def test_slabs_look_only_at_sides_near_a_change(monkeypatch):
    import numpy as np

    r, calls = np.random.default_rng(5), []
    reach = staircase.reach
    monkeypatch.setattr(staircase, "reach", lambda *a: calls.append(1) or reach(*a))
    for nodes in (60, 15):
        m, dmax = 3000, 30
        u, v, t = r.integers(0, nodes, m), r.integers(nodes, 12 * nodes, m), np.sort(r.integers(0, 400, m))
        x, edge = np.concatenate([u, v]), np.tile(np.arange(m), 2)
        order = np.lexsort((t[edge], x))
        edge, axis = edge[order], staircase.local_axis(x[order], t[edge[order]], dmax)
        own = (t > 40) & (t < 360)
        bound = np.where(own, 0, r.integers(0, dmax + 1, m))
        for k in (2, 3, 4):
            calls.clear()
            fast = staircase.onsets(edge, axis, own, bound, k, 0, dmax)
            assert len(calls) <= 12
            with monkeypatch.context() as slow:
                slow.setattr(staircase, "LINKED", 0)
                assert (staircase.onsets(edge, axis, own, bound, k, 0, dmax) == fast).all()
            assert len(np.unique(fast)) > 5


def test_components_of_a_long_chain_take_few_tables(spark, monkeypatch):
    """Chains over many tasks, of whole numbers, structs and bytes: no rounds, whatever their length."""
    from chronocore.operators import components

    made = []
    monkeypatch.setattr(components, "stored", lambda df: made.append(1) or stored(df))
    for kind in ("id", "struct(cast(id % 2 as int) as k, id as e)", "unhex(lpad(hex(id), 8, '0'))"):
        for few in (components.ONE, 0):
            monkeypatch.setattr(components, "ONE", few)
            node = lambda shift: kind.replace("id", f"(id + {shift})")  # noqa: B023, E731
            links = spark.range(0, 600, 1, 7).filter("id % 100 < 96").selectExpr(f"{node(2)} as a", f"{node(0)} as b").repartition(5)
            made.clear()
            found = rows(components.connected_components(links, ranged=kind == "id").selectExpr("to_json(struct(node)) as node", "to_json(struct(component)) as component"))
            names = [(n, r) for n, r in rows(links.selectExpr("to_json(struct(a as node))", "to_json(struct(b as node))"))]
            up = {}
            for a, b in sorted(names, key=lambda x: x[::-1]):
                up[a] = up.get(b, b)
            assert len(found) == len({x for p in names for x in p})
            groups = {}
            for n, c in found:
                groups.setdefault(c, set()).add(n)
            assert len(groups) == 12
            assert not few or len(made) <= 3


def test_large_levels_are_thinned_by_parts(spark, monkeypatch):
    graph = random_graph(11, m=300, nodes=12, span=60)
    g = stored(spark.createDataFrame(graph, "e long, u long, v long, t long"))
    level = stored(index.levels(stored(staircase.staircases(g, 0, 6))))
    pairs = stored(merges.candidates(g, level))
    whole = rows(merges.merges(pairs))
    assert rows(merges.candidates(g, level, 20)) == rows(pairs)  # each vertex in several slabs
    assert rows(merges.rounds(pairs)) == whole
    monkeypatch.setattr(merges, "PASSES", 1)
    assert rows(merges.candidates(g, level)) == rows(pairs)
    monkeypatch.setattr(merges, "rounds", None)
    assert rows(merges.merges(pairs.unionByName(pairs), most=60, nodes=40)) == whole


def test_index_is_not_broadcast(spark, golden):
    g, ix = golden
    queries = g.select("e", F.lit(0).alias("a"), F.lit(9).alias("b"), F.lit(1).alias("delta"), F.lit(2).alias("k"))
    level = stored(index.levels(ix))
    some = [index.area(ix, queries), index.point(ix, queries, 0, 9), index.onset(ix, queries), communities.links(g, ix.select("e"), 1), merges.candidates(g, level), merges.live(g.selectExpr("e as a", "e + 1 as b"), g, ix, 1, 3)]
    assert not any("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() for df in some)


def test_slabs_widen_when_edges_are_done(spark, monkeypatch):
    graph = random_graph(23, m=200, nodes=30, span=90)
    g = stored(spark.createDataFrame(graph, "e long, u long, v long, t long"))
    whole, widths = rows(staircase.staircases(g, 0, 6, width=400)), []
    plain = staircase.slab_width
    monkeypatch.setattr(staircase, "slab_width", lambda df, dmax: widths.append(plain(df, dmax, 20, 80)) or widths[-1])
    assert rows(staircase.staircases(g, 0, 6)) == whole
    assert len(widths) == 2 and widths[1] > widths[0]


def test_groups_are_dealt_in_turn(spark):
    rows = spark.range(0, 240, numPartitions=3).select(F.pmod("id", F.lit(12)).alias("slab"), "id")
    found = dealt(rows, F.col("slab"), 12, "slab").applyInPandas(lambda pdf: pdf.assign(n=len(pdf))[["slab", "n"]], "slab long, n long")
    got = set(found.withColumn("task", F.spark_partition_id()).collect())
    assert {tuple(x)[:2] for x in got} == {(i, 20) for i in range(12)} and len({x.task for x in got}) == 12


def test_trees_of_several_levels_beside_large_ones(spark, monkeypatch):
    """A community from the trees of one level alone is that from all trees, however trees are dealt to tasks."""
    g = stored(spark.createDataFrame(random_graph(11, m=300, nodes=12, span=60), "e long, u long, v long, t long"))
    ix = staircase.staircases(g, 0, 6)
    whole = forest.build(merges.build(g, ix), stored(index.levels(ix)))
    monkeypatch.setattr(forest, "LARGE", 2)
    dealt_ = forest.build(merges.build(g, ix), stored(index.levels(ix)))
    alone = forest.build(merges.build(g, ix, only=2), stored(index.levels(ix, only=2)))
    for i in range(2):
        assert rows(whole[i]) == rows(dealt_[i])
        assert rows(whole[i].filter("k = 2")) == rows(alone[i])


def _jobs(spark, group, make):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return make(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_grid_finds_all_cells_together(spark, monkeypatch):
    """Sizes are those of plain communities, and more cells take no more jobs; the same where no task holds a level."""
    graph = random_graph(29, m=220, nodes=6, span=60)
    g = stored(spark.createDataFrame(graph, "e long, u long, v long, t long"))
    ix = staircase.staircases(g, 0, 9)
    merged = merges.build(g, ix)
    found, many = _jobs(spark, "grid 6", lambda: rows(sweep.grid(g, ix, merged, uq=5)))
    _, few = _jobs(spark, "grid 2", lambda: rows(sweep.grid(g, ix, merged, uq=5, n=2)))
    assert many <= few + 2
    cells = rows(sweep.grid_cells(merged))
    assert [c[:3] for c in found] == cells and len({k for k, *_ in cells}) > 2
    reached = {k: {e: d for _, e, d in rows(index.levels(ix, only=k))} for k in {c[0] for c in cells}}
    for k, q, d, active, queries, mean, most, by_graph, agree in found[::3]:
        some = reached[k]
        by = plain_communities(graph, [e for e, d0 in some.items() if d0 <= d], d)
        drawn = spark.createDataFrame([(e,) for e in some], "e long").orderBy(F.xxhash64("e", F.lit(1), F.lit(q)), "e").limit(5)
        sizes = [list(by.values()).count(by[r.e]) for r in drawn.collect() if r.e in by]
        assert (active, queries, agree) == (len(by), len(sizes), True)
        assert (mean, most, by_graph) == ((sum(sizes) / len(sizes), max(sizes), mean) if sizes else (None, None, None))
    assert rows(sweep.grid(g, ix, merged, uq=5, held=0)) == found
    # Of pairs that leave some out, communities are smaller than those of the graph.
    assert not all(r.agree for r in sweep.grid(g, ix, merged.filter("a % 3 > 0"), uq=30).collect())
    monkeypatch.setattr(merges, "TARGET", 60)
    assert rows(sweep.grid(g, ix, merged, uq=5)) == found


def test_grid_of_no_edges_is_empty(spark, golden):
    g, ix = golden
    assert rows(sweep.grid(g, ix, merges.build(stored(g.limit(0)), ix))) == []


def test_large_levels_are_joined_block_by_block(spark, monkeypatch):
    """One forest, whether a task holds a level, reads it in blocks that go on over several, or never holds it."""
    g = stored(spark.createDataFrame(random_graph(13, m=400, nodes=20, span=60), "e long, u long, v long, t long"))
    pairs = stored(merges.candidates(g, stored(index.levels(stored(staircase.staircases(g, 0, 6))))))
    whole = rows(merges.merges(pairs))
    assert len({k for k, *_ in whole}) > 2
    monkeypatch.setattr(merges, "BLOCK", 7)
    monkeypatch.setattr(merges, "SHORTEN", 2)
    twice = pairs.unionByName(pairs)
    for held in (400, 0):
        assert rows(merges.merges(twice, most=60, nodes=40, held=held)) == whole
    # No task may sort, thin or relabel all pairs of a level.
    monkeypatch.setattr(merges, "_by_parts", None)
    monkeypatch.setattr(merges, "_kruskal", None)
    assert rows(merges.merges(pairs, most=0)) == whole


def test_grid_of_forests_that_no_task_holds(spark, monkeypatch):
    """The same cells whether a task holds a forest, reads it in blocks, or neither."""
    g = stored(spark.createDataFrame(random_graph(31, m=150, nodes=6, span=60), "e long, u long, v long, t long"))
    ix = staircase.staircases(g, 0, 9)
    merged = merges.build(g, ix)
    found = rows(sweep.grid(g, ix, merged, uq=5, n=2))
    assert rows(sweep.grid(g, ix, merged, uq=5, n=2, held=0, numbers=0)) == found
    monkeypatch.setattr(sweep, "_apart", None)
    monkeypatch.setattr(merges, "BLOCK", 20)
    assert found and rows(sweep.grid(g, ix, merged, uq=5, n=2, held=0)) == found


def test_communities_need_no_merges_of_larger_weight(spark):
    """Merges within a weight are those of all merges, and their trees give the same communities up to it."""
    g = stored(spark.createDataFrame(random_graph(17, m=120, nodes=12, span=90), "e long, u long, v long, t long"))
    ix = staircase.staircases(g, 0, 6)
    whole, near = merges.build(g, ix, only=2), merges.build(g, ix, only=2, within=6)
    assert rows(near) == rows(whole.filter("w <= 6")) and near.count() < whole.count()
    level = stored(index.levels(ix, only=2))
    (_, all_), (nodes, leaves) = forest.build(whole, level), forest.build(near, level)
    assert rows(leaves.select("k", "e", "onset")) == rows(all_.select("k", "e", "onset"))
    e = rows(level.select("e"))[5][0]
    found = rows(forest.community_of(nodes, leaves, 2, 6, e))
    assert len(found) > 1 and found == rows(merges.community_of(merges.distinct_pairs(whole), g, ix, 2, 6, e))


def test_trees_take_little_memory():
    """A tree of 60,000 leaves is made in under 32 MB: numbers are held in arrays, not as objects."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    n = 60_000
    pdf = pd.DataFrame({"k": np.int32(1), "tree": 0, "w": np.arange(n - 1) * 7919 % 1000, "a": (np.arange(1, n) - 1) // 2, "b": np.arange(1, n)})
    tracemalloc.start()
    out = forest._tree(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    nodes = out[out.kind == "node"]
    assert (len(nodes), nodes.cnt.max(), nodes.parent.isna().sum()) == (n - 1, n, 1)
    assert sorted(out[out.kind == "leaf"]["first"]) == list(range(n))
    assert peak < 32 << 20
