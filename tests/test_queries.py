"""Every registered query of the search engine against its SQL."""

from __future__ import annotations

import compare
import pytest

from corvane.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.views(SF)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    if name in registry.ORACLE_SQL:
        want = con.execute(registry.ORACLE_SQL[name]).to_arrow_table()
        assert compare.kinds(got) == compare.kinds(want)
        assert compare.rows(got) == compare.rows(want)
