"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tracelake import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    found = duck.execute(plans.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    order = [names.index(c) for c in sorted(names)]
    want = sorted(tuple(shown(r[i]) for i in order) for r in found.fetchall())
    assert sorted(names) == columns
    assert [[x.replace("nan", "None") for x in r] for r in got] == [[x.replace("nan", "None") for x in r] for r in want]
