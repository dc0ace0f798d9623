"""The queries of the subpackage: those with SQL against it, all with a stable schema."""

import glob
import os

import pytest

from korpusmill.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, data):
    df = queries.QUERIES[name](spark, data)
    rows = {tuple(sorted((c, str(v)) for c, v in r.asDict().items())) for r in df.collect()}
    assert df.columns
    if name in queries.ORACLES:
        con = duckdb.connect()
        for path in glob.glob(f"{data}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        cursor = con.execute(queries.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert rows == {tuple(sorted((c, str(v)) for c, v in zip(columns, r))) for r in cursor.fetchall()}
