"""Words are counted where their text is, and texts whose vectors are held travel nowhere."""

import hashlib
import re

from pyspark.sql import functions as F

from vellum.functions import embed
from vellum.operators import cache


def brute(text):
    counts = [0] * embed.DIMENSIONS
    for word in re.findall(r"[^\W_]+", text.lower()):
        digest = hashlib.md5(word.encode()).hexdigest()
        for j in range(embed.SPREAD):
            v = int(digest[4 * j : 4 * j + 4], 16)
            counts[v % embed.DIMENSIONS] += -1 if v // embed.DIMENSIONS % 2 else 1
    return counts


def test_counts_need_no_exchange(spark, monkeypatch):
    monkeypatch.setattr(embed, "ROWS", 3)
    texts = {i: ["", "a b a", "größe 7 – ok", " - ", "x" * 900 + " y" * i][i % 5] for i in range(23)}
    rows = spark.createDataFrame([*texts.items(), (99, None)], "id long, text string").coalesce(1)
    found = embed.counts(rows, "id")
    assert {r.id: r.counts for r in found.collect()} == {i: brute(t) for i, t in texts.items() if re.search(r"[^\W_]", t)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert embed.counts(rows.where("id = 0"), "id").collect() == [] and embed.counts(rows.limit(0), "id").collect() == []


def test_held_texts_are_left_where_they_are(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(20)] + [(50, None), (51, "-")], "id long, text string")
    for small in (0, 100):
        monkeypatch.setattr(cache, "SMALL", small)
        held = cache.Vectors(spark, f"{tmp_path}/{small}")
        first = held.add(rows.where("id < 3 or id > 40")).count()
        assert (first, held.computed) == (5, 5)
        every = {r.id: r.embedding for r in held.add(rows).collect()}
        assert held.computed == 4 and every[50] is None and every[51] is None and every[0] == every[7] != every[1]
        calls = []
        with monkeypatch.context() as m:
            m.setattr(embed, "vectors", lambda *a: calls.append(a))
            assert {r.id: r.embedding for r in held.add(rows.where(F.col("id") >= 0)).collect()} == every and held.computed == 0 and not calls
