"""Every named query of the core against its SQL twin on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tessera.plans import catalog  # noqa: E402
from verify import TABLES, rows_of  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracles()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got, columns = rows_of(df.columns, df.collect())
    if name in ORACLES:
        res = duck.execute(ORACLES[name])
        want, wanted = rows_of([d[0] for d in res.description], res.fetchall())
        assert columns == wanted
        assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
