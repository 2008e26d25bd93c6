"""Every registered query against its oracle SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tools.check import canon, connect
from workloads import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF)
    got = df.collect()
    cur = con.execute(all_oracles()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon(df.columns, got) == canon(columns, cur.fetchall())
    assert got, "a query should show something"
