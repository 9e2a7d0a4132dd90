"""Every query of the engine against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from recallgrid.plans.catalog import FLAGSHIP, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr(plain(list(r))) for r in df.select(*cols).collect())
    if name not in ORACLES:
        return
    found = db.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert rows == sorted(repr(plain([r[names.index(c)] for c in cols])) for r in found.fetchall())


def test_flagship(spark):
    import __spark_entry__

    assert FLAGSHIP in QUERIES and __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
