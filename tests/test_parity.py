"""Every registered query against its SQL twin, on the smallest data."""

import duckdb
import pytest

import parity
from longtally.plans import catalog
from tools.check_parity import TABLES, table_of

SF = "/root/testdata/sf0.001"
ORACLES = parity.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(catalog.load())


@pytest.mark.parametrize("name", sorted(catalog.load()))
def test_parity(spark, con, name):
    df = catalog.load()[name](spark, SF)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(ORACLES[name])
    assert got == table_of(rel.columns, rel.fetchall())
