import pytest

import __spark_entry__ as entry
from quernstone.plans import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.SQL[name], sf)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["v4_ivf", "v5_hnsw"])
def test_recall(spark, name):
    """Approximate searches find nine of ten of the nearest, over all queries."""
    f = "/root/testdata/sf0.01"
    pairs = lambda q: {(r.query_id, r.vec_id) for r in queries.QUERIES[q](spark, f).collect()}
    want = pairs("v1_knn_cosine")
    assert len(want & pairs(name)) >= 0.9 * len(want)
