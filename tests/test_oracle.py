"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from contrapair.plans import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# legitimately empty there: they ask for at least ten items per group
EMPTY = {"a2_screen_groups", "b3_choose_pair"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, con, name):
    msg, _ = compare(spark, con, SF, catalog.queries()[name], catalog.checks().get(name))
    assert msg == "" or (name in EMPTY and msg == "no rows"), msg


def test_every_check_has_a_query():
    assert set(catalog.checks()) <= set(catalog.queries())
