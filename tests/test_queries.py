"""Every query of the monitoring part against its SQL on the small tables."""

import pytest
from parity import assert_parity

from tidemark.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(name, spark, sf_dir):
    assert_parity(QUERIES[name], ORACLES[name], spark, sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
