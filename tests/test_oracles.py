"""Every core query against its SQL on the test tables; queries without SQL must run and keep their schema."""

import glob
import math
import os

import pytest

from korpusmill.plans import registry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    try:
        return round(float(v), 5) + 0.0 if not isinstance(v, (str, bytes)) else v
    except (TypeError, ValueError):
        return v


def table_of(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, data, con):
    df = registry.QUERIES[name](spark, data)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert df.columns and all(len(r) == len(df.columns) for r in rows)
        return
    cursor = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert table_of(rows, df.columns) == table_of(cursor.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
