"""Every registered query with an oracle matches DuckDB on the smallest scale."""

import pytest

from ringwise.catalog import ORACLE, QUERIES
from ringwise.checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
FAST = [n for n in sorted(ORACLE) if n.split("_")[0] in
        ("b1", "e1", "e6", "d1", "d2", "f4", "g1", "g6", "g8", "h7", "i3", "i6", "i8", "c6", "k3", "j5", "l3", "n8")]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    rep = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert rep["ok"], rep


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
