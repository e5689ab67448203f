"""Every registered query of the library against its SQL."""

import pytest

from oracle import same
from tidegauge.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, ORACLES[name], sf)
    else:
        assert df.count() > 0
