"""Every registered query against its DuckDB text at the smallest scale."""
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


# Queries with a limit, which acts only where a table has more rows.
LIMITED = sorted(n for n, q in ORACLE.items() if "limit" in q.lower() or "<= 20" in q)


def views(folder):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.fixture(scope="module")
def larger():
    return views(LARGER)


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v.normalize()) if isinstance(v, Decimal) else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() > 0


def compare(spark, con, name, folder):
    df = QUERIES[name](spark, folder)
    got = table(df.columns, df.collect())
    if name in ORACLE:
        cur = con.execute(ORACLE[name])
        want = table([d[0] for d in cur.description], cur.fetchall())
        assert got == want
    else:
        assert got[1]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    compare(spark, duck, name, SF)


@pytest.mark.parametrize("name", LIMITED)
def test_limits_where_they_act(spark, larger, name):
    compare(spark, larger, name, LARGER)
