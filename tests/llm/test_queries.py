"""The registered queries that SQL can express against their SQL."""

import pytest

from tests import oracle
from tokenfold.llm import queries as llm


@pytest.mark.skipif(not oracle.available(), reason="no tables")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, name):
    oracle.assert_same(spark, llm.queries()[name], llm.oracle_sql()[name])


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in llm.queries())
    assert len(numbers) == len(set(numbers)) and set(range(1, 11)) <= set(numbers)
