import pytest

import fernweave.queries as q
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_matches_sql(name, spark, sf):
    assert_same(q.QUERIES[name], q.ORACLE[name], spark, sf)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE)))
def test_query_has_rows(name, spark, sf):
    assert q.QUERIES[name](spark, sf).limit(1).count() == 1
