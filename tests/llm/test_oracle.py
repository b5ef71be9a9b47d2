"""Every query that has SQL beside it, on the smallest tables."""

import pytest

from check_oracle import connect, differences
from tidewatch.llm.queries import QUERIES, oracle

SQL = oracle()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir).sql(SQL[name])) is None
