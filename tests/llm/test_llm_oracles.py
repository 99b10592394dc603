"""The queries of the operators against their SQL."""

import comparing
import pytest

from driftgrid.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    comparing.assert_same(QUERIES[name](spark, sf_dir), comparing.duck(sf_dir), ORACLE_SQL[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
