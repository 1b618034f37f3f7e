"""Every query with an SQL twin agrees with DuckDB on the small tables; the others run."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def sql(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, small, sql):
    df = QUERIES[name](spark, small)
    got = sorted((tuple((c, norm(r[c])) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    rel = sql.sql(ORACLES[name])
    cols = list(rel.columns)
    want = sorted((tuple((c, norm(v)) for c, v in sorted(zip(cols, r))) for r in rel.fetchall()), key=repr)
    assert sorted(cols) == sorted(df.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith("p")))
def test_runs(name, spark, small):
    QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
