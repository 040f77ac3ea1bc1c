"""Every registered query against its SQL, over the whole tables at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from meander.workloads.oracles import ORACLES
from meander.workloads.queries import QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_graph_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    assert compare(spark, con, name, queries()[name], oracle_sql()[name], SF) is None


def test_entry(spark):
    assert entry(spark).columns == ["walk_no", "start", "path_text", "feats_text"]
