"""Sharding: the law, slots, digests, and how few groups are split."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from vellum.llm import shards

SCHEMA = "doc_id long, text string, shard string, hub int"


def checked(docs, found, number=16):
    """The law and the columns hold; the shards of each text."""
    sizes = {i: len((t or "").encode()) + 1 for i, t in docs if i is not None}
    texts = {i: t or "" for i, t in docs if i is not None}
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in docs)
    for r in found:
        if r.doc_id is not None:
            assert r["size"] == sizes[r.doc_id] and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < number
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    counts = [len(by[s]) for s in range(number)]
    assert max(counts) - min(counts) <= 1
    held = defaultdict(set)
    for r in found:
        if r.doc_id is not None:
            held[texts[r.doc_id]].add(r.shard)
    return held


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in docs], SCHEMA)


@pytest.mark.parametrize("hot,slices", [(1024, 256), (4, 3)])
def test_groups_stay_together(spark, monkeypatch, hot, slices):
    monkeypatch.setattr(shards, "HOT", hot)
    monkeypatch.setattr(shards, "SLICES", slices)
    rng, docs = random.Random(1), []
    for g in range(60):  # groups of 2 to 6 copies
        docs += [f"group {g}"] * rng.randint(2, 6)
    docs += ["third"] * 300 + [None] * 3 + [""] * 2 + [f"alone {i}" for i in range(351)] + ["größer " * 20_000]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    held = checked(docs, shards.sharded(frame(spark, docs)).collect())
    quota = len(docs) // 16
    assert len(held["third"]) <= -(-300 // quota) + 1  # as few shards as hold it, and one at a border
    split = [t for t, s in held.items() if len(s) > 1 and t != "third"]
    assert len(split) <= 15  # one at each border of two rooms


def test_nothing_but_links(spark):
    docs = list(enumerate(["same"] * 100))
    assert len(checked(docs, shards.sharded(frame(spark, docs)).collect())["same"]) == 16
    docs = list(enumerate([f"pair {i // 2}" for i in range(320)]))
    held = checked(docs, shards.sharded(frame(spark, docs)).collect())
    assert sum(len(s) > 1 for s in held.values()) <= 16


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = [(None, "x"), (None, "x"), (7, "x"), (7, "x"), (8, None), (9, "")]
    checked(docs, shards.sharded(frame(spark, docs)).collect())
    assert shards.sharded(frame(spark, [])).collect() == []


def test_hubs_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = shards.sharded(frame(spark, rows)).collect()
    assert sorted(found, key=lambda r: r.doc_id) == sorted(shards.sharded(frame(spark, rows)).collect(), key=lambda r: r.doc_id)
    held = checked(rows, found)
    assert sum(len(s) > 1 for s in held.values()) == 0
