"""Repeated byte strings against all windows: slices of long texts, self-similar texts, and the production span."""

import hashlib
import random
from collections import Counter

import pytest

from vellum.llm import repeats


def brute(rows, span):
    n = Counter(b[i : i + span] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - span + 1))
    for doc, t in rows:
        b = (t or "").encode()
        gone, last = bytearray(len(b)), 0
        for i in range(len(b) - span + 1):
            if n[b[i : i + span]] > 1:
                for j in range(max(i, last), i + span):
                    gone[j] = 1
                last = i + span
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield doc, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def found(spark, rows, span):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, repeats.removed(docs, span).drop("n_kept", "repeated").collect()), key=repr)


def morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("slice_of", [4 << 20, 100, 37])
def test_slices(spark, monkeypatch, slice_of):
    monkeypatch.setattr(repeats, "SLICE", slice_of)
    r = random.Random(6)
    words = ["alpha", "béta", "gamma", "delta", "a", "zeta", "Épsilon"]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = said(40)
    texts = [said(r.randrange(1, 200)) + (shared[r.randrange(30) :] if i % 3 == 0 else "") + said(20) for i in range(30)]
    texts += [shared, "x" * 300, "ab" * 200, morse(900), morse(700)[13:], None, "", texts[0], said(30) + shared + said(30) + shared]
    rows = list(enumerate(texts))
    assert found(spark, rows, 40) == sorted(brute(rows, 40), key=repr)


def test_production_span(spark):
    """All documents of the smallest table, a long text that holds one of them, and self-similar words."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    r = random.Random(8)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(150_000))
    rows += [(9001, long[:500_000] + rows[3][1] * 2 + long[500_000:]), (9002, long[700_000:701_000]), (9003, morse(3000)), (9004, morse(6000)[1000:])]
    assert found(spark, rows, repeats.SPAN) == sorted(brute(rows, repeats.SPAN), key=repr)
