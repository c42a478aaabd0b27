"""Indexed search against a scan, and how many texts it looks at."""

import random

from vellum.operators import trigrams
from vellum.operators.trigrams import Index


def test_search_equals_a_scan(spark, tmp_path):
    r = random.Random(3)
    words = ["alpha", "Beta", "größer", "İstanbul", "x", "needle", "Straße", "日本語テキスト", "a%b_c", "ab\nc"]
    texts = [" ".join(r.choice(words[:5] if i % 50 else words) for _ in range(r.randrange(1, 30))) for i in range(400)] + [None, "", "ne", "NEEDLE", "needl e"]
    rows = list(enumerate(texts))
    index, report = Index(spark, f"{tmp_path}/i").build(spark.createDataFrame(rows, "id long, text string")), {}
    terms = ["Needle", "needle", "beta", "be", "größ", "日本語", "straße", "a%b_", "b\nc", "absent words", "eta g", "", "lphA B"]
    found = sorted((x.term, x.id) for x in index.search(*terms).collect())
    assert found == sorted((t, i) for t in terms for i, x in rows if x is not None and t.lower() in x.lower())
    assert index.search("Needle", "absent words", report=report).count() == sum("needle" in (x or "").lower() for x in texts)
    assert report["read"] < 0.1 * report["rows"] and report["scanned"] == []
    assert index.search("qqqq", report=report).collect() == [] and report["read"] == 0
    told = {x.id: x.score for x in trigrams.scores(index, ["needle", "beta", "größer"]).collect()}
    assert told == {i: 0.25 * n for i, x in rows if (n := sum(t in (x or "").lower() for t in ("needle", "beta", "größer")))}
