"""The operators' queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from vellum.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings labels conversations".split()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    found = QUERIES[name](spark, DIR)
    rows, columns = found.collect(), sorted(found.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    told = db.sql(ORACLES[name])
    at = [told.columns.index(c) for c in columns]
    assert sorted(told.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=repr)
