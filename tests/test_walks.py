"""Walks: exact small cases, invariants, draw frequencies, plans."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from meander.functions import draw
from meander.operators import adjacency as A, alias, transition as T, walk as W
from meander.operators import triangles
from meander.operators.joins import attach
from meander.operators.triangles import shared_places
from meander.schemas import schema
from tests.conftest import rows

TRIANGLE = [(0, 1), (1, 2), (0, 2), (2, 3)]
RING = [(i, (i + 1) % 12) for i in range(12)] + [(i, (i + 5) % 12, 2) for i in range(12)]


def adjacent(adj):
    return {(r.id, r.nbr): r.feat for r in A.adj_edges(adj).collect()}


@pytest.mark.parametrize("p, q", [(1.0, 1.0), (0.5, 1.0), (0.25, 4.0), (3.0, 0.7)])
def test_shape_of_walks(graph, scratch, p, q):
    adj = graph(RING)
    edge = adjacent(adj)
    walks = W.random_walk(adj, 7, 3, p, q, seed=1, checkpoint_every=3, scratch=scratch).collect()
    assert sorted((w.walk_no, w.start) for w in walks) == [(n, v) for n in range(3) for v in range(12)]
    for w in walks:
        assert len(w.path) == 9 and len(w.feats) == 8 and w.path[0] == w.start
        for i in range(8):
            assert edge[w.path[i], w.path[i + 1]] == w.feats[i] == f"f{w.path[i + 1]}"


@pytest.mark.parametrize("p, q", [(1.0, 1.0), (0.3, 1.0), (0.25, 4.0)])
def test_same_walks_however_they_are_run(spark, graph, scratch, p, q):
    adj = graph(RING + TRIANGLE)
    def run(**how):
        return rows(W.random_walk(adj, 6, 2, p, q, seed=5, scratch=scratch, **how))
    want = run()
    assert run(checkpoint_every=2) == want
    assert run(num_partitions=3) == want
    assert run(walks_per_task=2, checkpoint_every=4) == want
    assert rows(W.random_walk(adj, 6, 2, p, q, seed=6, scratch=scratch)) != want


def test_hubs_are_spread(spark, graph, scratch):
    star = graph([(0, k) for k in range(1, 400)])
    hubs = W.find_hubs(star, 10, walks_per_task=500)
    assert rows(hubs) == [(0, 8)]
    layout = W.lay_out(star, hubs)
    assert layout.table.where("id = 0").count() == 8
    state = W.walk_start(layout, 10, 3).where("start <> 0")
    chosen = W._choose_copy(state, 1).groupBy("to_copy").count().collect()
    assert len(chosen) == 8 and max(r["count"] for r in chosen) < 700
    assert W.find_hubs(star, 10).isEmpty()
    layout = replace(layout, table=scratch.cut(layout.table))
    state = W.walk_start(layout, 10, 3)
    plan = W._advance(state, layout, 1, 2, 1.0, 1.0, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_many_walks_from_one_start_are_spread(spark, graph, scratch):
    """All walks stand on the start's neighbours or on the start itself."""
    adj = scratch.cut(graph([(0, 1), (0, 2), (0, 3, 2), (3, 4)] + [(k, k + 1) for k in range(10, 50)]))
    starts = spark.createDataFrame([(0,)], "id bigint")
    assert dict(rows(W.find_hubs(adj, 1000, 200, starts))) == {0: 5, 1: 2, 2: 2, 3: 3}
    def run(**how):
        return rows(W.random_walk(adj, 6, 1000, seed=4, starts=starts, scratch=scratch, checkpoint_every=2, **how))
    want = run()
    assert len(want) == 1000 and run(walks_per_task=100) == want


def test_walks_that_gather_late_are_spread(spark, graph, scratch):
    """Few edges lead to a heavy pair, but what gets there stays there."""
    adj = scratch.cut(graph([(i, (i + 1) % 60) for i in range(60)] + [(0, 100, 5), (100, 101, 1e6)]))
    def run(**how):
        return W.random_walk(adj, 12, 20, seed=2, scratch=scratch, checkpoint_every=3, **how)
    want = rows(run())
    assert rows(run(walks_per_task=100)) == want
    met = run().select(F.element_at("path", -1).alias("cur"))
    copies = dict(rows(W.crowded(met, None, walks_per_task=22)))
    assert set(copies) == {100, 101} and min(copies.values()) > 2
    assert W.crowded(met, None).isEmpty()
    over = scratch.cut(W.crowded(met, None, walks_per_task=22))
    assert W.crowded(met, over, walks_per_task=22).isEmpty()
    again = W.more_copies(W.lay_out(adj).persist(), over, scratch)
    assert again.table.where("id = 100").count() == copies[100] and again.spread
    again.release()


def test_forced_paths(graph, scratch):
    walks = W.random_walk(graph([(0, k) for k in range(1, 6)]), 5, 2, scratch=scratch).collect()
    for w in walks:
        assert all(w.path[i] == 0 for i in range(0 if w.start == 0 else 1, 7, 2))
    line = W.random_walk(graph([(0, 1), (1, 2)]), 3, 4, scratch=scratch).where("start = 0").collect()
    assert all(w.path[1] == 1 and w.path[3] == 1 and w.path[2] in (0, 2) for w in line)


@pytest.mark.parametrize("every", [8, 1])
def test_directed_walks_end(graph, scratch, every):
    adj = graph([(0, 1), (1, 2), (3, 0)], directed=True)
    got = W.random_walk(adj, 5, 2, directed=True, checkpoint_every=every, scratch=scratch)
    want = {0: [0, 1, 2], 1: [1, 2], 3: [3, 0, 1, 2]}
    assert rows(got) == sorted(
        ((n, s, path, [f"f{v}" for v in path[1:]]) for n in range(2) for s, path in want.items()), key=repr)


def test_no_return_when_p_is_huge(graph, scratch):
    walks = W.random_walk(graph(RING), 6, 5, p=1e12, scratch=scratch).collect()
    assert all(w.path[i] != w.path[i + 2] for w in walks for i in range(6))


def test_starts_and_zero_length(spark, graph, scratch):
    starts = spark.createDataFrame([(1,), (3,), (77,), (1,)], "id bigint")
    walks = W.random_walk(graph(RING), 0, 2, starts=starts, scratch=scratch).collect()
    assert sorted((w.start, w.walk_no, len(w.path)) for w in walks) == [
        (1, 0, 2), (1, 1, 2), (3, 0, 2), (3, 1, 2)]


def test_walks_from_one_vertex_differ(graph, scratch):
    walks = W.random_walk(graph(RING), 4, 20, scratch=scratch).where("start = 0").collect()
    assert len({tuple(w.path) for w in walks}) > 10


def test_hop_tags(spark, graph):
    walks = spark.createDataFrame([(0, 0, [0, 2, 3, 2, 1, 0], ["f"] * 5)], schema("walks"))
    got = W.hop_tag(walks, graph(TRIANGLE)).orderBy("hop").collect()
    assert [(r.hop, r.node, r.tag) for r in got] == [(1, 2, 1), (2, 3, 2), (3, 2, 1), (4, 1, 1), (5, 0, 0)]


def test_multi_walk_and_feature_walk(graph, scratch):
    walks = W.random_walk(graph(TRIANGLE), 2, 1, scratch=scratch)
    assert W.multi_walk([walks, walks, walks]).count() == 12
    assert W.feature_walk(walks).columns == ["walk_no", "start", "feats"]


def test_empty_graph(spark, scratch):
    adj = spark.createDataFrame([], schema("adj"))
    assert W.random_walk(adj, 3, 2, scratch=scratch).count() == 0
    assert W.random_walk(adj, 9, 2, checkpoint_every=2, scratch=scratch).count() == 0
    assert W.weighted_draw(adj, 1).count() == 0


@pytest.mark.parametrize("weights", [[1.0, 2.0, 3.0], [0.1, 0.2, 0.7, 1e-6], [5.0]])
def test_reach_and_pick_agree_with_a_plain_search(spark, weights):
    total = sum(weights)
    amounts = [total * k / 997 for k in range(1, 997)] + [total, total * (1 + 1e-15)]
    want = []
    for a in amounts:
        run, at = 0.0, len(weights)
        for i, w in enumerate(weights):
            run += w
            if run >= a:
                at = i + 1
                break
        want.append(at)
    w = F.array(*[F.lit(x) for x in weights])
    df = spark.createDataFrame([(i, a) for i, a in enumerate(amounts)], "i int, a double")
    df = df.withColumn("sums", draw.running(w))
    got = df.select("i", draw.reach(F.col("sums"), F.col("a")).alias("r"),
                    draw.pick(w, F.col("a")).alias("k")).orderBy("i").collect()
    assert [r.r for r in got] == want
    assert sum(r.k != x for r, x in zip(got, want)) <= 2  # sums and rests round differently


@pytest.mark.parametrize("method", W.METHODS)
@pytest.mark.parametrize("p, q", [(1.0, 1.0), (0.25, 1.0), (4.0, 1.0), (0.25, 4.0), (4.0, 0.25)])
def test_draws_follow_the_transition_tables(graph, scratch, p, q, method):
    adj = graph([(0, 1, 2), (1, 2), (0, 2, 3), (2, 3), (3, 4, 2), (4, 0)])
    walks = W.random_walk(adj, 1, 6000, p, q, seed=9, scratch=scratch, method=method).select("path").collect()
    firsts, seconds = {}, {}
    for (path,) in walks:
        a, b, c = path
        firsts.setdefault(a, []).append(b)
        seconds.setdefault((a, b), []).append(c)
    for r in T.transition1(adj).collect():
        drawn = firsts[r.id]
        assert abs(drawn.count(r.nbr) / len(drawn) - r.prob) < 5 * (0.25 / len(drawn)) ** 0.5
    for r in T.transition2(adj, p, q).collect():
        drawn = seconds[r.prev, r.cur]
        assert abs(drawn.count(r.nbr) / len(drawn) - r.prob) < 5 * (0.25 / len(drawn)) ** 0.5


@pytest.mark.parametrize("p, q, hubs", [(1.0, 1.0, False), (0.5, 2.0, False), (1.0, 1.0, True)])
def test_one_shuffle_per_step_and_no_python(spark, graph, scratch, p, q, hubs):
    adj = scratch.cut(graph(RING))
    copies = spark.createDataFrame([(0, 3)], "id bigint, copies int") if hubs else None
    layout = W.lay_out(adj, copies, biased=q != 1).persist()
    layout.table.count()
    def shuffles(steps):
        state = W._advance(W.walk_start(layout, 2, 1), layout, 1, steps, p, q, 1)
        plan = state._jdf.queryExecution().executedPlan()
        text = plan.toString()
        assert "Python" not in text
        # Nothing but numbers travels.
        assert "string" not in [t for _, t in state.dtypes]
        return exchanges(text)
    def exchanges(text):
        return sum(line.strip(" :+-").startswith("Exchange") and "ENSURE_REQUIREMENTS" in line
                   for line in text.split("\n"))
    # Every step also shows the plan of the kept lists.
    kept = exchanges(layout.table._jdf.queryExecution().executedPlan().toString())
    assert shuffles(3) - shuffles(2) == 1 + kept
    layout.release()


def plain_shared(adj):
    lists = {r.id: [e.nbr for e in r.nbrs] for r in adj.collect()}
    out = {}
    for v, own in lists.items():
        for at, c in enumerate(own):
            places = [i for i, z in enumerate(lists.get(c, [])) if z in own]
            if places:
                out[v, at] = places
    return out


@pytest.mark.parametrize("degree, directed", [(50, False), (3, False), (4, True)])
def test_shared_places(spark, graph, scratch, degree, directed):
    rnd = random.Random(degree)
    edges = [(rnd.randrange(40), rnd.randrange(40), rnd.randint(1, 5)) for _ in range(250)] + [(0, k) for k in range(40)]
    adj = scratch.cut(graph(edges, degree, directed))
    want = plain_shared(adj)
    assert {(r.id, r["at"]): r.shared for r in shared_places(adj, scratch).collect()} == want and len(want) > 20
    assert any(e[0] == e[1] for e in edges)
    lists = {r.id: r.nbrs for r in adj.collect()}
    for r in T.transition_lists(adj, 0.5, 4.0, scratch).collect():
        near = {e.nbr for e in lists[r.prev]}
        b = [e.weight / (0.5 if e.nbr == r.prev else 1 if e.nbr in near else 4) for e in lists[r.cur]]
        assert [(e.nbr, e.prob) for e in r.next] == [(e.nbr, x / sum(b)) for e, x in zip(lists[r.cur], b)]


def test_no_empty_slots_move_and_stretches_are_not_collected(spark, graph, scratch):
    adj = scratch.cut(graph([(0, 1), (1, 2), (2, 3), (4, 0)], directed=True))
    layout = W.lay_out(adj, directed=True, scratch=scratch).persist()
    state = W.walk_start(layout, 1, 3)
    assert [c for c in state.columns if W._is_slot(c)] == ["v1", "f1"]
    assert [c for c in W.walk_step(state, layout, 1, 1.0, 1.0, 3).columns if W._is_slot(c)] == ["v1", "v2", "f1", "f2"]
    layout.release()
    walks = W.random_walk(adj, 4, 1, seed=3, directed=True, checkpoint_every=1, scratch=scratch)
    assert "collect_list" not in walks._jdf.queryExecution().executedPlan().toString()
    assert {r.start: (r.path, r.feats) for r in walks.collect()} == {
        0: ([0, 1, 2, 3], ["f1", "f2", "f3"]), 1: ([1, 2, 3], ["f2", "f3"]), 2: ([2, 3], ["f3"]), 4: ([4, 0, 1, 2, 3], ["f0", "f1", "f2", "f3"])}


@pytest.mark.parametrize("p, q", [(1.0, 1.0), (0.5, 1.0), (0.5, 2.0)])
def test_sums_are_sorted_as_plain_numbers(spark, graph, scratch, p, q):
    layout = W.lay_out(scratch.cut(graph([(0, 1), (1, 2), (2, 0, 3)])), scratch=scratch, biased=q != 1).persist()
    assert not layout.table.schema["sums"].dataType.containsNull
    step = W.walk_step(scratch.cut(W.walk_start(layout, 1, 3)), layout, 1, p, q, 3)
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "sort_array(concat(sums" in plan and "array_insert" not in plan
    layout.release()


@pytest.mark.parametrize("steps, per_task", [(2, 1_000_000), (5, 4)])
def test_kept_layout_serves_several_walks(spark, graph, scratch, steps, per_task):
    adj = scratch.cut(graph([(i, (i * i + 1) % 9) for i in range(30)]))
    layout = W.lay_out(adj, scratch=scratch).persist()
    for num_walks in (1, 2):
        again = W.random_walk(layout, steps, num_walks, seed=3, checkpoint_every=2, scratch=scratch, walks_per_task=per_task)
        assert layout.kept
        assert rows(again) == rows(W.random_walk(adj, steps, num_walks, seed=3, scratch=scratch))
    layout.release()
    assert not layout.kept


def test_degrees_are_looked_up_only_where_one_list_has_the_other(spark, graph, scratch, monkeypatch):
    looked_up, attach = [], triangles.attach
    monkeypatch.setattr(triangles, "attach", lambda rows, table, on, **more: (
        looked_up.append(rows.count()) if on == "v" else None) or attach(rows, table, on, **more))
    star = [(0, i) for i in range(1, 7)] + [(1, 2)]
    shared_places(scratch.cut(graph(star)), scratch).count()
    shared_places(scratch.cut(graph(star, degree=2)), scratch).count()
    assert looked_up == [0, 4]


def test_lists_sent_for_triangles_are_bare_ids_behind_the_edge(spark, graph, scratch, monkeypatch):
    """What moves for an edge is the part of the list that a third vertex can be in, without places."""
    rng, moved = random.Random(3), []
    adj = scratch.cut(graph([(rng.randrange(60), rng.randrange(60)) for _ in range(500)]))
    monkeypatch.setattr(triangles, "attach", lambda rows, *rest, **more: moved.append(rows) or attach(rows, *rest, **more))
    shared_places(adj, scratch).count()
    ups = {r.a: r.n for df in moved if "a" in df.columns and "after" in df.columns
           for r in df.groupBy("a").agg((F.max("i") + 2).alias("n")).collect()}
    sent = [df for df in moved if any(t.startswith("array") for _, t in df.dtypes)]
    assert [t for _, t in sent[0].dtypes if t.startswith("array")] == ["array<int>"] and len(sent) == 1
    assert sent[0].agg(F.sum(F.size("after"))).first()[0] == sum(n * (n - 1) // 2 for n in ups.values()) > 0
    wide = scratch.cut(adj.select((F.col("id") + (1 << 40)).alias("id"), F.transform("nbrs", lambda e: F.struct(
        (e["nbr"] + (1 << 40)).alias("nbr"), e["weight"].alias("weight"), e["feat"].alias("feat"))).alias("nbrs")))
    places = lambda lists: sorted((r.id % (1 << 40), r["at"], r.shared) for r in shared_places(lists, scratch).collect())
    assert places(wide) == places(adj)


def test_alias_tables_give_every_entry_its_weight(spark, graph, scratch):
    rnd = random.Random(3)
    adj = graph([(i, j, rnd.choice([0.1, 1, 2, 7, 500])) for i in range(30) for j in range(30) if rnd.random() < 0.4] + [(90, 91)])
    weight = {(r.id, r.nbr): r.weight for r in A.adj_edges(adj).collect()}
    got, total, nbr, count = {}, {}, {}, {}
    tables = alias.alias_tables(adj).collect()
    for r in tables:
        nbr[r.id, r.place], total[r.id], count[r.id] = r.nbr, r.total, count.get(r.id, 0) + 1
    for r in tables:
        assert 0 < r.prob <= r.total
        for to, w in ((r.nbr, r.prob), (nbr[r.id, r.other], r.total - r.prob)):
            got[r.id, to] = got.get((r.id, to), 0) + w / count[r.id]
    assert got == pytest.approx(weight)


@pytest.mark.parametrize("p, q", [(1.0, 1.0), (0.25, 4.0), (2.0, 0.5)])
def test_same_alias_walks_however_they_are_run(spark, graph, scratch, p, q):
    adj = scratch.cut(graph(RING + TRIANGLE))
    def run(**how):
        return rows(W.random_walk(adj, 5, 2, p, q, seed=5, scratch=scratch, method="alias", **how))
    want = run()
    edge = adjacent(adj)
    assert all(edge[a, b] == f for _, _, path, feats in want for a, b, f in zip(path, path[1:], feats))
    assert run(checkpoint_every=2, num_partitions=3) == want
    assert run(walks_per_task=2, checkpoint_every=4) == want


def test_features_travel_as_text_where_they_are_many(graph, scratch):
    adj = scratch.cut(graph(RING))
    plain = W.lay_out(adj, scratch=scratch, feature_bytes=10)
    coded = W.lay_out(adj, scratch=scratch)
    assert plain.features is None and coded.features is not None
    assert rows(W.random_walk(plain, 4, 2, scratch=scratch)) == rows(W.random_walk(coded, 4, 2, scratch=scratch))


def test_a_long_list_is_drawn_in_proportion(spark, scratch):
    n = 10_000
    one = spark.range(n).select(F.lit(-1).cast("bigint").alias("id"), F.col("id").alias("nbr"),
                                (1 + F.col("id") % 3).cast("double").alias("weight"), F.lit("f").alias("feat"))
    adj = A.gather(one)
    tables = scratch.cut(alias.alias_tables(adj))
    copies = tables.crossJoin(spark.range(40).withColumnRenamed("id", "k")).withColumn("id", F.col("k"))
    drawn = [r.nbr % 3 for r in alias.alias_draw(copies, 5).collect()]
    assert len(drawn) == 40 and 0 <= drawn.count(0) < 20


def test_short_walks_lay_the_lists_out_once(spark, graph, scratch):
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    walks = W.random_walk(graph(RING), 4, 2, scratch=scratch)
    plan = walks._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_unknown_method(graph):
    with pytest.raises(ValueError, match="method"):
        W.lay_out(graph(RING), method="none")


@pytest.mark.parametrize("method, q, directed, crowd", [("sums", 1.0, False, None), ("alias", 2.0, False, None),
                                                       ("sums", 1.0, True, None), ("sums", 1.0, False, 10)])
def test_walks_go_on_after_a_stop(graph, scratch, tmp_path, monkeypatch, method, q, directed, crowd):
    adj = scratch.cut(graph(RING + [(3, 40), (40, 3, 50)], directed=directed))
    folder = str(tmp_path / "walks")
    advance, steps = W._advance, []
    def run(seed=2, **how):
        steps.clear()
        return rows(W.random_walk(adj, 7, 2, q=q, seed=seed, method=method, directed=directed, checkpoint_every=2,
                                  scratch=scratch, walks_per_task=crowd or W.WALKS_PER_TASK, **how))
    def stopping(state, layout, first, *rest):
        steps.append(first)
        if first == stop_at:
            raise RuntimeError("stopped")
        return advance(state, layout, first, *rest)
    monkeypatch.setattr(W, "_advance", stopping)
    stop_at = None
    want = run()
    stop_at = 5
    with pytest.raises(RuntimeError):
        run(resume=folder)
    stop_at = None
    assert run(resume=folder) == want and steps == [5, 7]
    assert run(resume=folder) == want and steps == []
    assert run(seed=3, resume=folder) != want and steps == [1, 3, 5, 7]


@pytest.mark.parametrize("p, q, method", [(1.0, 1.0, "alias"), (0.25, 1.0, "alias"), (0.25, 0.5, "alias"), (1.0, 1.0, "sums"), (0.25, 4.0, "sums")])
def test_no_method_of_a_step_is_too_long_to_be_compiled(spark, scratch, graph, p, q, method):
    adj = scratch.cut(graph([(i, (i + k) % 40) for i in range(40) for k in (1, 2, 3)]))
    hubs = adj.select("id", F.lit(2).alias("copies")).limit(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        layout = W.lay_out(adj, scratch.cut(hubs), scratch=scratch, method=method, biased=q != 1)
        state = W._advance(W.walk_start(layout, 1, 7), layout, 1, 8, p, q, 7)
        code = state._jdf.queryExecution().debug().codegenToSeq()
        # HotSpot leaves longer methods to its interpreter for good.
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("method", ["sums", "alias"])
def test_without_shared_neighbours_nothing_about_them_travels(spark, scratch, graph, method):
    adj = scratch.cut(graph([(i, 100 + (i + k) % 9, 1 + k) for i in range(12) for k in (0, 1, 3)]))
    layout = W.lay_out(adj, scratch=scratch, method=method, biased=True)
    state = W.walk_start(layout, 2, 7)
    assert layout.near is None and "shared" not in state.columns and "shared" not in layout.table.columns
    step = W.walk_step(state, layout, 1, 0.25, 4.0, 7)
    assert method == "alias" or "lambda" not in step._jdf.queryExecution().optimizedPlan().toString()
    linked = {(r.id, e.nbr) for r in adj.collect() for e in r.nbrs}
    walks = W.random_walk(adj, 6, 3, 0.25, 4.0, 7, scratch=scratch, method=method).collect()
    assert len(walks) == 63 and all((a, b) in linked for w in walks for a, b in zip(w.path, w.path[1:]))
    with pytest.raises(ValueError):
        W.walk_step(state, W.lay_out(adj, scratch=scratch, method=method), 1, 0.25, 4.0, 7).collect()
