"""Every registered query of the context-assembly part against its SQL."""

import pytest

from tests import oracle
from tokenfold.plans.oracles import ORACLES
from tokenfold.plans.queries import queries


@pytest.mark.skipif(not oracle.available(), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    oracle.assert_same(spark, queries()[name], ORACLES[name])
