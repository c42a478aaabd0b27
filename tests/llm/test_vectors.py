"""Exact top-k search against brute force: mixed lengths, ties, repeated rows, clashing names, and what elimination saves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import vectors

def asks():
    return F.col("vec_id") % 100 == 0


def brute(rows, k=10):
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        best = sorted((-int(v @ w), i) for other, v in good if other == q for i, w in good if i != q and len(w) == len(v))[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return want


def found(df):
    return sorted(map(tuple, df.collect()))


def test_lengths_ties_and_bad_rows(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(9 if i % 4 == 3 or i == 300 else 8)]) for i in range(340)]
    rows += [(5, [0.5] * 8), (5, [0.5] * 8), *[(1000 + i, [0.9] * 8) for i in range(30)], (100, [0.1] * 8), (400, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (500, []), (501, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clash = table.withColumns({c: F.lit(1) for c in ("pack", "block", "width", "cell", "near", "tau", "rank", "score", "query_id", "q", "x", "asks")})
    assert found(vectors.search(table, asks())) == brute(rows) == found(vectors.search(clash, asks()))
    assert found(vectors.search(table.where("vec_id % 100 <> 0"), asks())) == [] == found(vectors.search(table.limit(0), asks()))


def test_large_components(spark):
    rows = [(i, [float((i * 7919 + j * 104729) % 1000003) for j in range(4)]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(1024 * x) for x in v]) for i, v in rows]
    want = []
    for q, v in whole:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert found(vectors.search(table, asks())) == want


def test_elimination(spark, monkeypatch):
    """In clustered data, most pairs of packs aren't shipped, and most candidates of a shipped pack aren't evaluated."""
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "PACK", 2)
    r = np.random.default_rng(2)
    centres = r.normal(0, 1, (20, 8))
    rows = [(i, (centres[i % 20] + r.normal(0, 0.01, 8)).astype(np.float32).tolist()) for i in range(3000)]
    shipped, whole = [], vectors.evaluated

    def watched(pairs, queries, candidates, k):
        shipped.append((pairs.count(), queries.select("pack").distinct().count() * candidates.select("pack").distinct().count()))
        return whole(pairs, queries, candidates, k)

    monkeypatch.setattr(vectors, "evaluated", watched)
    assert found(vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), asks())) == brute(rows)
    assert sum(n for n, _ in shipped) < 0.5 * shipped[0][1]
    x = np.floor(1024 * np.array([v for _, v in rows]))
    dist = vectors.distances(x, x[:64])
    ids = np.arange(len(x))
    got, n = vectors.tile(ids[:30], x[:30], dist[:30], np.full(30, -np.inf), ids, x, dist, 10)
    assert n < 0.3 * 30 * len(x) and [i for i, *_ in got] == list(range(30))
    carried = np.array([s[-1] for _, _, s in got])
    again, fewer = vectors.tile(ids[:30], x[:30], dist[:30], carried, ids, x, dist, 10)
    assert fewer <= n and all((a[1] == b[1]).all() for a, b in zip(got, again))


@pytest.mark.parametrize("size", [1, 3])
def test_products_beyond_doubles(size):
    x, q = np.full((2, size), 2.0**30 + 1), np.full(size, 2.0**30 + 3)
    assert [int(v) for v in vectors.products(x, q)] == [size * (2**30 + 1) * (2**30 + 3)] * 2


@pytest.mark.parametrize("lengths,elements", [(2, 8_000_000), (1000, 40), (1, 1)])
def test_more_lengths_than_have_pivots(spark, monkeypatch, lengths, elements):
    monkeypatch.setattr(vectors, "LENGTHS", lengths)
    monkeypatch.setattr(vectors, "ELEMENTS", elements)
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(1 + i % 7 + i // 100)]) for i in range(420)]
    assert found(vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), asks())) == list(brute_doubles(rows))


def brute_doubles(rows, k=10):
    whole = [(i, np.floor(1024 * np.array(v))) for i, v in rows]
    for q, v in whole:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in whole if i != q and len(w) == len(v))[:k]
            yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
