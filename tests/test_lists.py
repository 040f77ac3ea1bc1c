"""Neighbour lists as a bucketed table: same walks, no exchange of lists, also from another session."""

import pytest

from meander.operators import adjacency as A, lists as L, walk as W
from tests.conftest import rows

RING = [(i, (i + 1) % 12) for i in range(12)] + [(i, (i + 5) % 12, 2) for i in range(12)] + [(0, 2), (0, 1)]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if line.strip(" :+-").startswith("Exchange")]


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / "lists")


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("method, p, q", [("sums", 1.0, 1.0), ("alias", 1.0, 1.0), ("sums", 0.5, 2.0), ("alias", 0.5, 2.0)])
def test_same_walks(spark, graph, scratch, path, method, p, q):
    adj = scratch.cut(graph(RING))
    saved = L.save_lists(adj, path, 5)
    def run(lists, **how):
        return rows(W.random_walk(lists, 5, 2, p, q, seed=3, scratch=scratch, method=method, **how))
    assert run(saved) == run(adj)
    assert run(saved, walks_per_task=5, checkpoint_every=2) == run(adj)


def test_lists_are_laid_out_where_they_are(spark, graph, scratch, path, no_broadcast):
    L.save_lists(scratch.cut(graph(RING)), path, 8)
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    lists = L.open_lists(other, path)
    assert lists.buckets == 8 and rows(A.adj_edges(lists.table)) == rows(A.adj_edges(graph(RING)))
    for method in W.METHODS:
        layout = W.lay_out(lists.table, num_partitions=8, placed=True, method=method, scratch=scratch)
        # The dictionary of features is all that is sent.
        assert [x for x in exchanges(layout.table) if "Broadcast" not in x] == []
    plain = W.lay_out(graph(RING), num_partitions=8, scratch=scratch)
    assert len([x for x in exchanges(plain.table) if "hashpartitioning(id" in x]) >= 1


def test_held_lists_are_not_moved_again(spark, graph, scratch, path, no_broadcast):
    edges = scratch.cut(spark.createDataFrame([(a, b, "x", "y", 1.0) for a, b, *_ in RING],
                                              "src_id bigint, dst_id bigint, src_feat string, dst_feat string, weight double"))
    adj = A.adjacency(edges, hot=[])
    assert len(exchanges(adj.repartition(8, "id"))) == len(exchanges(adj)) == 1
    lists = L.hold_lists(adj, path)
    assert lists.buckets == 8 and L._name(path) not in [t.name for t in spark.catalog.listTables()]
    assert rows(A.adj_edges(lists.table)) == rows(A.adj_edges(adj))
    layout = W.lay_out(lists, scratch=scratch)
    assert [x for x in exchanges(layout.table) if "Broadcast" not in x] == []


def test_tags_of_hops_read_lists_in_place(spark, graph, scratch, path, no_broadcast):
    adj = scratch.cut(graph(RING))
    lists = L.save_lists(adj, path, 8)
    walks = scratch.cut(W.random_walk(lists, 5, 2, seed=3, scratch=scratch))
    moved = exchanges(W.hop_tag(walks, lists))
    assert len(moved) == 1 and "start" in moved[0]
    assert rows(W.hop_tag(walks, lists)) == rows(W.hop_tag(walks, adj))


def test_saved_lists_are_not_overwritten(spark, graph, path):
    L.save_lists(graph(RING), path, 2)
    with pytest.raises(Exception):
        L.save_lists(graph(RING), path, 2)
