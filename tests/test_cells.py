"""Nearest vectors by cells against all distances, and how many pairs are compared."""

import numpy as np
import pytest

from vellum.operators import cells, retrieval

VECTORS = "vec_id long, embedding array<float>, part string"
PROBES = "probe_id string, probe array<double>, part string"


def brute(vectors, probes, k):
    found = {}
    for name, probe, part in probes:
        if probe is None:
            continue
        rows = [(float(np.sqrt(((np.float32(v).astype(float) - probe) ** 2).sum())), i) for i, v, p in vectors if p == part and v is not None and len(v) == len(probe) and all(x is not None and np.isfinite(x) for x in v)]
        for rank, (_, i) in enumerate(sorted(rows)[:k], 1):
            found[name, rank] = i
    return found


def clustered(rng, n, clusters=20):
    middles = rng.normal(size=(clusters, 6)) * 10
    return [[float(np.float32(x)) for x in middles[rng.integers(clusters)] + rng.normal(size=6)] for _ in range(n)]


def told(found):
    return {(r.probe_id, r["rank"]): r.vec_id for r in found.collect()}


@pytest.mark.parametrize("block,pack", [(2048, 256), (9, 4)])
def test_exact(spark, monkeypatch, block, pack):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "PACK", pack)
    rng = np.random.default_rng(1)
    some = clustered(rng, 300)
    vectors = [(i, v, "ab"[i % 2]) for i, v in enumerate(some + [some[0]] * 40)]  # many at one place
    vectors += [(900, None, "a"), (901, [1.0, 2.0], "a"), (902, [None] + [0.0] * 5, "a"), (903, [float("nan")] * 6, "a"), (904, [0.0] * 6, "alone")]
    probes = [(f"q{i}", v, "ab"[i % 2]) for i, v in enumerate(some[:30])] + [("none", None, "a"), ("one", [0.0] * 6, "alone"), ("nowhere", [0.0] * 6, "zzz")]
    found = cells.nearest(spark.createDataFrame(vectors, VECTORS), spark.createDataFrame(probes, PROBES), 7)
    assert told(found) == brute(vectors, probes, 7)


def test_bounds_leave_out_most_pairs_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 32)
    monkeypatch.setattr(cells, "PACK", 8)
    rng, report = np.random.default_rng(2), {}
    vectors = [(i, v, "") for i, v in enumerate(clustered(rng, 2000))]
    probes = [(f"q{i}", v, "") for i, v in enumerate(clustered(np.random.default_rng(2), 60))]
    found = cells.nearest(spark.createDataFrame(vectors, VECTORS), spark.createDataFrame(probes, PROBES), 5, report)
    assert told(found) == brute(vectors, probes, 5)
    assert report["compared"] < 0.3 * 2000 * 60


def test_many_probes_have_no_nested_loop(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0], "") for i in range(50)], VECTORS).drop("part")
    probes = vectors.selectExpr("vec_id as probe_id", "embedding as probe")
    plan = retrieval.dense_topk(vectors, probes, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert retrieval.dense_topk(vectors, probes, 3).count() == 150


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], VECTORS)
    assert cells.nearest(none, spark.createDataFrame([("q", [1.0], "")], PROBES), 3).collect() == []
    assert cells.nearest(none, spark.createDataFrame([], PROBES), 3).collect() == []
