"""Periodic runs against their definition, word by word."""

import hashlib
import random
import zlib

import pytest

from vellum.llm import periods

SCHEMA = "text string, doc_id long, start string"


def brute(doc_id, text, plant, least=24, times=3):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text or "").split(" ") if w]
    n = len(words)
    if plant and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    has = lambda s, e, q: all(words[i] == words[i + q] for i in range(s, e - q))
    runs = []
    for q in range(1, n // times + 1):
        for s in range(n - q):
            if words[s] != words[s + q] or (s and words[s - 1] == words[s - 1 + q]):
                continue
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(least, times * q) and not any(has(s, e, d) for d in range(1, q)):
                runs.append((s, q, e - s))
    runs.sort()
    best = None
    for s, q, size in runs:
        if best is None or size * best[1] > best[2] * q:
            best = (s, q, size)
    gone = {i for s, q, size in runs for i in range(s + q, s + size)}
    shown = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    lines = "".join(f"{s},{size},{q}\n" for s, q, size in runs)
    return doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def texts():
    rng = random.Random(3)
    yield from [(None, 1, "x"), ("", 2, None), (" \n\t ", 3, "x"), ("one", 4, "x"), ("a " * 200, 5, "x"), ("a b " * 30, None, "x"), ("a b " * 30, None, "x"), ("   x\x0by" * 20, 6, "x")]
    for i in range(7, 140):
        words = []
        while len(words) < rng.choice((30, 80, 300)):
            some = [rng.choice("abcdefghij"[: rng.choice((2, 3, 10))]) for _ in range(rng.randint(1, 12))]
            words += some * rng.choice((1, 1, 2, 4, 9)) + some[: rng.randint(0, len(some))]
        yield rng.choice((" ", "  ", "\n", "\r\n")).join(words), i, "x"


@pytest.mark.parametrize("plant", [False, True])
def test_all_runs(spark, plant):
    rows = list(texts())
    found = periods.detected(spark.createDataFrame(rows, SCHEMA), plant=plant)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((brute(d, t, plant) for t, d, _ in rows), key=repr)


def test_long_texts_in_ranges_of_lags(spark, monkeypatch):
    monkeypatch.setattr(periods, "ALONE", 150)
    monkeypatch.setattr(periods, "LAGS", 7)
    rows = list(texts())
    found = periods.detected(spark.createDataFrame(rows, SCHEMA), plant=True)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((brute(d, t, True) for t, d, _ in rows), key=repr)


def test_a_very_long_text(spark):
    rng = random.Random(5)
    head, unit = [f"w{rng.randrange(9000)}" for _ in range(60_000)], [f"u{i}" for i in range(25_000)]
    text = " ".join(head + unit * 3 + unit[:10] + ["end"])
    assert len(text) > periods.ALONE and len(unit) > periods.LAGS  # the period lies in the second range
    row = periods.detected(spark.createDataFrame([(text, 0, "x")], SCHEMA)).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 60_000, 75_010, 25_000)
    assert row.collapsed_sha256 == hashlib.sha256(" ".join(head + unit + ["end"]).encode()).hexdigest()


def test_no_rows(spark):
    assert periods.detected(spark.createDataFrame([], SCHEMA)).collect() == []
