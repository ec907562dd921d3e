"""Every registered query against the same query as SQL in another engine."""

import os

import pytest

import __spark_entry__ as contract
from faultledger.testbed.catalog import QUERIES
from faultledger.testbed.oracles import ORACLES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def connection(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_is_registered_with_its_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_equals_oracle(spark, connection, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = _sorted(tuple(r[c] for c in columns) for r in frame.collect())
    cursor = connection.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = _sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert got == want
    # At the smallest scale no week reaches the limit.
    assert got or name == "weekly_over_threshold"


def test_entry(spark):
    assert contract.entry(spark).count() == 150
