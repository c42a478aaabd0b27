"""Pieces and ids against the file's own tokenizer; rounds against plain best fit, with one range and with many."""

import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from vellum.llm import packing
from vellum.llm.queries import tokenizer_path


def best_fit(lengths, capacity):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        if at < len(gaps):
            gap = gaps.pop(at)
        else:
            gap, n = capacity, n + 1
        if gap > length:
            insort(gaps, gap - length)
    return n


def valid(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(held)


@pytest.mark.parametrize("size", [100_000, 40])
def test_rounds(spark, monkeypatch, size):
    monkeypatch.setattr(packing, "RANGE", size)
    r = random.Random(3)
    cases = [[r.randrange(1, 65) for _ in range(400)], [64] * 30 + [22] * 40 + [1] * 70 + [r.choice([31, 32, 33, 63]) for _ in range(100)]]
    if size > 40:  # a single range is one task, also where the session deals each sorting by ranges over many partitions
        sort = DataFrame.repartitionByRange
        monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, n, *by: sort(self, max(n, 13), *by))
    for lengths in cases if size > 40 else cases[:1]:
        pieces = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").withColumns({c: F.lit(1) for c in ("size", "id", "gap", "turn", "sequence", "part")}).repartition(5)
        done = packing.packed(pieces, 64)
        rows = done.collect()
        assert sorted((x.doc_id, x.length) for x in rows) == list(enumerate(lengths)) and set(done.columns) == {*pieces.columns, "sequence_id", "offset"}
        # One range is plain best fit, but for the sequences that open between two rounds.
        assert valid(rows, 64) <= best_fit(lengths, 64) * (1 if size > 40 else 1.03) + 1


def test_brackets():
    r = random.Random(5)
    for _ in range(200):
        ranges = [(p, r.randrange(0, 4), r.randrange(0, 4)) for p in range(r.randrange(1, 7))]
        stack, want, waiting = [], {}, defaultdict(int)
        for part, pieces, gaps in ranges:
            for i in range(pieces):
                if stack:
                    want[part, i] = stack.pop()
            stack += [(part, j) for j in range(gaps)]
        runs, matched = packing.brackets(ranges)
        got = {(part, first + i): (gap_part, last - i) for part, first, n, gap_part, last in runs for i in range(n)}
        assert got == want and all(matched[p] == sum(k[0] == p for k in want) for p, _, _ in ranges)
        assert not waiting


def test_pieces(spark):
    ids = packing.Ids(tokenizer_path())
    assert ids.fast is not None
    r = random.Random(9)
    long = " ".join(r.choice(["alpha", "béta", "12", "x,", "Ünit", "\n"]) for _ in range(3000))
    texts = ["a  b\n\n c 123 don't ÉÜ", "<|endoftext|>x", "   ", "", None, "x", "日本語 text", "caf́e    \u0085 z", "привет — мир…", "\U0001f600‍", long, "퟿", "a" * 5000, long]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, "no id")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("piece", "start", "length", "ids_crc32", "pid", "sequence_id", "offset", "size", "gap")})
    rows = packing.pack(docs, tokenizer_path(), 64).collect()
    want = []
    for i, text in [*enumerate(texts), (0, texts[0]), (None, "no id")]:
        assert ids(text or "") == ids._slow(text or "")
        flat = np.array([*ids._slow(text or ""), 0], "<u4")
        first = len(flat) % 64 or 64
        bounds = [0, *range(first, len(flat) + 1, 64)]
        want += [(i, n, a, b - a, zlib.crc32(flat[a:b].tobytes())) for n, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows), key=str) == sorted(want, key=str)
    lengths = [x.length for x in rows]
    assert valid(rows, 64) <= best_fit(lengths, 64) + 1 and packing.pack(docs.limit(0), tokenizer_path()).count() == 0
