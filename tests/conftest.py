import pytest

from meander.operators import adjacency as A
from meander.scratch import Scratch
from tests.session import session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture()
def scratch(spark, tmp_path):
    return Scratch(spark, str(tmp_path))


@pytest.fixture()
def lines(spark):
    return lambda *values: spark.createDataFrame([(v,) for v in values], "value string")


@pytest.fixture()
def graph(spark, scratch):
    """Neighbour lists of a graph given by (source, target[, weight]) ids."""
    def make(edges, degree=50, directed=False):
        rows = [(e[0], e[1], f"f{e[0]}", f"f{e[1]}", float(e[2]) if len(e) > 2 else 1.0) for e in edges]
        schema = "src_id bigint, dst_id bigint, src_feat string, dst_feat string, weight double"
        return A.adjacency(spark.createDataFrame(rows, schema), degree, directed)
    return make


def rows(df, *order):
    """The rows of a table as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
