"""Every query of the engine against its SQL, on the driver's smallest tables."""

import os

import duckdb
import pytest

from helixgrid.plans import catalog
from helixgrid.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def normal(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLE:
        assert df.count() >= 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = con.execute(ORACLE[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert normal([tuple(row[c] for c in cols) for row in df.collect()]) == normal(r.fetchall())
