"""Padding, ids and neighbour lists, with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from meander.operators import adjacency as A, index as I, joins as J, padding as P, transition as T
from meander.schemas import TABLES, expect, schema
from meander.sources import readers as R, writers as W
from tests.conftest import rows


def test_padding(spark, lines):
    edges = R.edges_from_lines(lines("d1 i1", "d1 i2", "d2 i1", "d1 i1"))
    one, two = (R.features_from_lines(lines(*f)) for f in (("d1 A", "d1 B", "d1 A"), ("i1 X",)))
    padded = P.pad_edges(edges, one, two)
    assert rows(W.padded_lines(padded)) == [("d1\u0001A i1\u0001X",), ("d1\u0001B i1\u0001X",)]
    assert rows(P.node2feat(padded)) == [("d1", "A"), ("d1", "B")]
    assert rows(P.node2feat(padded, "both")) == [("d1", "A"), ("d1", "B"), ("i1", "X")]
    with pytest.raises(ValueError):
        P.node2feat(padded, "dst")


def test_ids_follow_name_order(spark, scratch, lines):
    padded = R.padded_from_lines(lines("b a", "a c"))
    ids = I.node_index(padded, scratch)
    assert rows(ids) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(I.index_edges(padded, ids)) == [(0, 2, "a", "c", 1.0), (1, 0, "b", "a", 1.0)]


def test_ids_are_dense_over_many_ranges(spark, scratch):
    n = 5000
    names = spark.range(n).select((F.col("id") * 7919 % n).cast("string").alias("src"))
    padded = names.select("src", F.lit("f").alias("src_feat"), F.col("src").alias("dst"),
                          F.lit("f").alias("dst_feat"), F.lit(1.0).alias("weight"))
    got = dict(rows(I.node_index(padded, scratch)))
    assert got == {name: i for i, name in enumerate(sorted(str(k) for k in range(n)))}


def test_parallel_edges(spark, scratch, lines):
    padded = R.padded_from_lines(lines("a\u0001F b\u0001G", "b\u0001G a\u0001F", "a\u0001F b\u0001H"))
    adj = A.adjacency(I.index_edges(padded, I.node_index(padded, scratch)))
    assert rows(A.adj_edges(adj)) == [(0, 1, 1.0, "G"), (1, 0, 1.0, "F")]


def test_degree_cap(graph):
    star = [(9, 1, 1), (9, 2, 3), (9, 3, 3), (9, 4, 2)]
    def kept(edges, degree):
        return [r[1] for r in rows(A.adj_edges(graph(edges, degree))) if r[0] == 9]
    assert kept(star, 2) == [2, 3]
    assert kept(star, 3) == [2, 3, 4]
    assert kept([e[:2] for e in star], 2) == [1, 2]
    # A dropped neighbour keeps its own entry.
    assert (1, 9, 1.0, "f9") in rows(A.adj_edges(graph(star, 2)))


def test_large_cap_cuts_in_slices(spark):
    edges = spark.range(3000).select(F.lit(1).cast("bigint").alias("id"), F.col("id").alias("nbr"),
                                     (F.col("id") % 10).cast("double").alias("weight"),
                                     F.lit("f").alias("feat"))
    want = sorted(((-(n % 10), n) for n in range(3000)))[:1500]
    assert sorted((-r.weight, r.nbr) for r in A.degree_cap(edges, 1500).collect()) == want


def test_cap_is_taken_before_the_shuffle(spark, graph):
    edges = spark.createDataFrame([], schema("adj_edges"))
    plan = A.degree_cap(edges.repartition(4, "id", "nbr"), 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_weights_and_direction(spark, graph):
    assert rows(A.adj_edges(graph([(1, 2, 5), (1, 2, 7), (2, 1, 3)]))) == [
        (1, 2, 7.0, "f2"), (2, 1, 7.0, "f1")]
    assert rows(A.adj_edges(graph([(1, 2), (1, 3)], directed=True))) == [
        (1, 2, 1.0, "f2"), (1, 3, 1.0, "f3")]
    assert rows(A.adj_edges(graph([(4, 4)]))) == [(4, 4, 1.0, "f4")]
    indexed = spark.createDataFrame([(1, 2, "a", "b", 5.0)], schema("indexed_edges"))
    assert rows(A.adj_edges(A.adjacency(indexed, weighted=False))) == [
        (1, 2, 1.0, "b"), (2, 1, 1.0, "a")]


def test_triplets(graph):
    got = A.triplets(graph([(1, 2), (2, 3)])).select(
        "src_id", "dst_id", F.col("src_nbrs.nbr").alias("s"), F.col("dst_nbrs.nbr").alias("d"))
    assert rows(got) == [(1, 2, [2], [1, 3]), (2, 1, [1, 3], [2]), (2, 3, [1, 3], [2]), (3, 2, [2], [1, 3])]


TRIANGLE = [(0, 1), (1, 2), (0, 2), (2, 3)]


def test_transitions(graph):
    adj = graph(TRIANGLE)
    one = {(r.id, r.nbr): r.prob for r in T.transition1(adj).collect()}
    assert one[0, 1] == 1 / 2 and one[3, 2] == 1 and all(one[2, n] == 1 / 3 for n in (0, 1, 3))
    two = {(r.prev, r.cur, r.nbr): r.prob for r in T.transition2(adj, 0.25, 4.0).collect()}
    assert two[0, 2, 0] == pytest.approx(4 / 5.25)
    assert two[0, 2, 1] == pytest.approx(1 / 5.25)
    assert two[0, 2, 3] == pytest.approx(0.25 / 5.25)
    sums = {}
    for (prev, cur, _), prob in two.items():
        sums[prev, cur] = sums.get((prev, cur), 0) + prob
    assert len(sums) == 8 and all(s == pytest.approx(1) for s in sums.values())


@pytest.fixture()
def no_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def test_only_keys_over_the_share_are_hot(spark, scratch):
    rows = spark.range(5000).selectExpr("if(id < 100, 0, id) as k", "id as other")
    assert J.hot_keys(scratch.cut(rows), ["k", "other"]) == {"k": [0], "other": []}


def test_ids_of_targets_are_joined_to_written_edges_in_place(spark, scratch, no_broadcast):
    edges = spark.range(6000).selectExpr("concat('a', id) as src", "concat('b', id % 2000) as dst", "1.0D as weight")
    one = edges.selectExpr("src as node", "'x' as feat").distinct()
    two = edges.selectExpr("dst as node", "'y' as feat").distinct()
    padded = P.pad_edges(edges, one, two, scratch, written=True)
    assert rows(padded) == rows(P.pad_edges(edges, one, two, scratch))
    ids = scratch.cut(I.node_index(padded, scratch))
    indexed = I.index_edges(padded, ids)
    plan = indexed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Bucketed: true" in plan  # ids twice, edges once
    assert indexed.count() == 6000


def test_totals_of_transition_lists_are_worked_out_once_a_pair(graph, scratch):
    adj = graph([(1, 2), (1, 3, 3), (2, 3)])
    plan = T.transition_lists(adj, 0.25, 4.0, scratch)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.splitlines()[0]
    assert "transform(" in top and "aggregate(" not in top  # a total in the lambda would be one for every entry


def test_tables_with_lists_are_not_broadcast(spark, graph, scratch):
    adj = scratch.cut(graph([(0, k) for k in range(1, 40)] + [(1, 2), (2, 3)]))
    assert J.planned_bytes(adj) < 10 << 20
    plan = A.triplets(adj)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_hot_keys_are_found_and_spread(spark, no_broadcast):
    edges = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("n"), "id")).alias("src"),
        F.col("id").cast("string").alias("dst"))
    assert "hub" in J.frequent_keys(edges, ["src"])["src"]
    table = edges.select("src").distinct().select("src", F.length("src").alias("n"))
    joined = J.attach(edges, table, "src")
    assert "__salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 30000 and joined.where("n <> length(src)").count() == 0
    with_copies = J.attach(edges.unionAll(edges), table.unionAll(table), "src")
    assert with_copies.count() == 120000
    hub_tasks = (joined.where("src = 'hub'").groupBy(F.spark_partition_id()).count().count())
    assert hub_tasks > 1


def test_salted_joins_change_nothing(spark, scratch, lines, no_broadcast):
    edges = R.edges_from_lines(lines(*[f"h i{k}" for k in range(300)], "a i1", "b i2", "c none"))
    one = R.features_from_lines(lines("h A", "h B", "a A", "b C"))
    two = R.features_from_lines(lines(*[f"i{k} X{k % 3}" for k in range(300)]))
    padded = P.pad_edges(edges, one, two)
    want = ([(f"h\u0001{f} i{k}\u0001X{k % 3}",) for k in range(300) for f in "AB"]
            + [("a\u0001A i1\u0001X1",), ("b\u0001C i2\u0001X2",)])
    assert rows(W.padded_lines(padded)) == sorted(want, key=repr)
    padded = scratch.cut(padded)
    ids = scratch.cut(I.node_index(padded, scratch))
    names = {i: n for n, i in rows(ids)}
    got = I.index_edges(padded, ids).collect()
    assert sorted((f"{names[r.src_id]}\u0001{r.src_feat} {names[r.dst_id]}\u0001{r.dst_feat}",) for r in got) == sorted(want)
    adj = A.adjacency(I.index_edges(padded, ids))
    assert A.triplets(adj).count() == A.adj_edges(adj).count() == T.transition1(adj).count()


def test_distinct_edges_are_worked_out_once(spark, lines, scratch, no_broadcast):
    """The look for hot keys reads the written edges, and so do the joins."""
    edges = R.edges_from_lines(lines(*[f"h i{k}" for k in range(300)], "a i1", "a i1"))
    one, two = R.features_from_lines(lines("h A", "a B")), R.features_from_lines(lines("i1 X", "i2 Y"))
    read = spark.sparkContext.accumulator(0)
    edges = spark.createDataFrame(edges.rdd.map(lambda r: (read.add(1), r)[1]), edges.schema)
    padded = P.pad_edges(edges, one, two, scratch)
    assert rows(padded.select("src", "src_feat", "dst", "dst_feat")) == [
        ("a", "B", "i1", "X"), ("h", "A", "i1", "X"), ("h", "A", "i2", "Y")]
    assert read.value == 302


def test_names_of_targets_move_once(spark, scratch, lines, no_broadcast):
    """Edges are joined by target first, in whose order they lie, and go on without its name."""
    padded = P.pad_edges(R.edges_from_lines(lines("a x", "b x", "b y")), R.features_from_lines(lines("a A", "b B")),
                         R.features_from_lines(lines("x X", "y Y")), scratch)
    padded = scratch.cut(padded)
    plan = I.index_edges(padded, scratch.cut(I.node_index(padded, scratch)))._jdf.queryExecution().executedPlan().toString()
    assert -1 < plan.index("hashpartitioning(src#") < plan.index("hashpartitioning(dst#")


@pytest.mark.parametrize("directed", [False, True])
def test_neighbours_move_once_and_hubs_are_cut_before(spark, scratch, no_broadcast, directed):
    """One exchange of the edges for vertices without too many of them; the lists are those of the operators apart."""
    names = "src_id bigint, dst_id bigint, src_feat string, dst_feat string, weight double"
    made = [(0, k, "h", f"f{k % 7}", float(k % 3 + 1)) for k in range(400)] + [
        (k, (k * 7) % 400, f"f{k % 7}", f"f{k % 5}", 1.0) for k in range(400)] * 2
    edges = scratch.cut(spark.createDataFrame(made, names))
    want = rows(A.gather(A.degree_cap(A.neighbour_edges(edges, directed), 5)))
    for hot in (None, [], [0, 7]):
        assert rows(A.adjacency(edges, 5, directed, hot=hot)) == want
    plan = A.adjacency(edges, 5, directed, hot=[])._jdf.queryExecution().executedPlan().toString()
    assert sum(line.strip(" :+-").startswith("Exchange") for line in plan.split("\n")) == 1
    assert "WindowGroupLimit" in A.adjacency(edges, 5, directed)._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark, scratch):
    empty = {name: spark.createDataFrame([], schema(name)) for name in TABLES}
    padded = P.pad_edges(empty["edges"], empty["features"], empty["features"])
    ids = I.node_index(padded, scratch)
    adj = A.adjacency(I.index_edges(padded, ids))
    for df, name in ((padded, "padded"), (ids, "node2id"), (adj, "adj"), (A.adj_edges(adj), "adj_edges")):
        assert expect(df, name).count() == 0
    assert T.transition1(adj).count() == T.transition2(adj).count() == A.triplets(adj).count() == 0


def test_wrong_tables_are_refused(spark):
    with pytest.raises(TypeError, match="weight: need double, have nothing"):
        expect(spark.createDataFrame([], "src string, dst string"), "edges")
