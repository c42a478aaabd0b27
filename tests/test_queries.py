"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from vellum.plans import answer_queries, card_queries, function_queries, queries, retrieval_queries, store_queries, word_queries

MODULES = (queries, function_queries, card_queries, retrieval_queries, store_queries, answer_queries, word_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, DIR)
    rows, columns = found.collect(), sorted(found.columns)
    if name not in ORACLES:
        assert rows
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    told = db.sql(ORACLES[name])
    at = [told.columns.index(c) for c in columns]
    assert sorted(told.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=repr)
