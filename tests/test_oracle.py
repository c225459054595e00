"""Every registered query of the engine against its DuckDB SQL, at the smallest size."""

import datetime

import duckdb
import pytest

from barline.plans import oracle, oracle_indicators, oracle_learning, oracle_search, oracle_ticks
from barline.plans.queries import QUERIES

ORACLE_SQL = oracle.ORACLE_SQL | oracle_search.ORACLE_SQL | oracle_ticks.ORACLE_SQL | oracle_indicators.ORACLE_SQL | oracle_learning.ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return repr(round(x + 0.0, 9)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    own = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in own.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(map(plain, r)) for r in own.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == expected
