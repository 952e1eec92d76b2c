from __future__ import annotations

import pytest
from compare import differences

from riskloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    assert differences(spark, sf, queries.queries()[name], queries.oracle_sql()[name]) == []


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
