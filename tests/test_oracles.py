"""Every registered query with an oracle, beside DuckDB, at the smallest scale."""

import pytest

from check_oracles import canonical, database
from shopledger.plans.catalogue import QUERIES
from shopledger.plans.oracles import SQL, oracles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(SQL))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(oracles()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = canonical(columns, cursor.fetchall())
    assert want
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
