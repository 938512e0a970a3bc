import re

import __spark_entry__ as registered
import pytest
from compare import check, duck

NO_TWIN = {"ivf_cells_kmeans"}
# the training-data operators have their own tests, and may be absent
OWN = {n for n in registered.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}


@pytest.fixture(scope="module")
def connection(tiny):
    return duck(tiny)


def test_every_query_has_a_twin():
    assert OWN - set(registered.oracle_sql()) == NO_TWIN
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_twin(spark, tiny, connection, name):
    sql = registered.oracle_sql().get(name)
    difference, n_rows, *_ = check(spark, connection, tiny, registered.queries()[name], sql)
    if sql is None:
        assert n_rows > 0
    else:
        assert difference is None


def test_entry(spark):
    found = registered.entry(spark)
    assert found.columns == ["item_id", "chunk_id", "doc_id", "sim", "rank"]
    assert found.count() > 0
