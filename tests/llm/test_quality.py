"""Gated attention against a plain forward pass and numerical gradients; whole documents in training; odd labels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import quality


def test_forward_and_gradient():
    r = np.random.default_rng(4)
    model, n = quality.Model(), 5
    x, bag, y = r.normal(0, 1, (17, quality.WIDTH)), np.sort(r.integers(0, n - 1, 17)), np.array([0.0, 1, 1, 0, 1])  # the last bag is empty
    p = model.p

    def plain():
        scores = []
        for b in range(n):
            hs, es = [], []
            for i in np.flatnonzero(bag == b):
                h = [max(0.0, sum(v * w for v, w in zip(np.clip(x[i], -6, 6), p["W"][:, j])) + p["b"][j]) for j in range(quality.HIDDEN)]
                gate = sum(p["w"][g] * math.tanh(np.dot(h, p["V"][:, g])) / (1 + math.exp(-np.dot(h, p["U"][:, g]))) for g in range(quality.GATE))
                hs.append(h)
                es.append(math.exp(gate))
            z = [sum(e * h[j] for e, h in zip(es, hs)) / sum(es) if es else 0.0 for j in range(quality.HIDDEN)]
            scores.append(1 / (1 + math.exp(-(np.dot(z, p["c"]) + p["d"][0]))))
        return np.array(scores)

    assert np.allclose(model.forward(x, bag, n)["score"], plain(), atol=1e-12)

    def loss():
        s = model.forward(x, bag, n)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    gradient = model.gradient(x, bag, y)
    for name, value in p.items():
        flat, told = value.reshape(-1), gradient[name].reshape(-1)
        for i in r.integers(0, len(flat), 6):
            kept, step = flat[i], 1e-6
            flat[i] = kept + step
            high = loss()
            flat[i] = kept - step
            low = loss()
            flat[i] = kept
            assert (high - low) / (2 * step) == pytest.approx(told[i], rel=1e-4, abs=1e-8), name


def test_features_by_hand():
    text = "Ab c, 12!\nÉ ab ab #" + " w" * 60
    owner, x = quality.passages([b"", text.encode(), b"x"])
    words = text.split()
    assert owner.tolist() == [1, 1, 2] and x.shape == (3, quality.WIDTH)
    first, chars = words[:64], len("".join(words[:64]).encode())
    assert x[0][1] == sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for w in first for c in w) / chars
    assert x[0][2] == 2 / chars and x[0][3] == 1 / chars and x[0][-1] == pytest.approx(math.log1p(64) / 5)
    assert x[0][-5] == len(set(first)) / 64


def test_every_passage_is_learned_from(spark, monkeypatch):
    """A label that one late passage of a long text causes, and a bound on all passages that leaves out whole documents only."""
    r = random.Random(6)
    good = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        bad = i % 2
        rows.append((i, good(64 * 50) + (" " + " ".join(["#$%&*"] * 64) if bad else "") + " " + good(64 * 10), 1))
        labels.append((i, 1 - bad))
    rows += [(1000, None, 1), (1001, "", 1), (1002, good(20000), 1), (0, "x", 1)]
    labels += [(1000, 1), (5, None), (7, 1), (1001, 0), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").withColumns({c: F.lit(1) for c in ("score", "digest", "n", "x", "quality", "held_out")})
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    seen = []
    fit = quality.Model.fit
    monkeypatch.setattr(quality.Model, "fit", lambda self, bags, y, seed=5: seen.append(sorted(map(len, bags))) or fit(self, bags, y, seed))
    got = quality.classified(docs, table).collect()
    assert seen[0][-1] == 61 and seen[0][0] in (1, 60) and len(got) == len(rows)
    held = [(x.score >= 0.5) == (x.doc_id % 2 == 0) for x in got if x.held_out and 0 < x.doc_id < 300]
    assert sum(held) >= 0.95 * len(held)
    again = {x.doc_id: x.score for x in quality.classified(docs.repartition(5), table).collect() if x.doc_id}
    assert again == pytest.approx({x.doc_id: x.score for x in got if x.doc_id})
    monkeypatch.setattr(quality, "TRAIN_PASSAGES", 500)
    quality.train(docs, table)
    assert sum(seen[-1]) <= 500 and set(seen[-1]) <= {1, 60, 61} and len(seen[-1]) >= 8
