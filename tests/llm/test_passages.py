"""Passages of over 50 words that stand elsewhere too, also those below 400 bytes, against brute force."""

import random
from collections import Counter

from vellum.llm import repeats


def brute(texts, n=51):
    words = {i: (x or "").split() for i, x in texts}
    seen = Counter(tuple(w[i : i + n]) for w in words.values() for i in range(len(w) - n + 1))
    return {k: len({j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}) for k, w in words.items()}


def test_short_words_in_long_passages(spark):
    r = random.Random(6)
    some = lambda n: [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randrange(40)) for _ in range(n)]
    texts = []
    for n in (49, 50, 51, 52, 60, 75, 110):
        passage = some(n)
        for before, after in ((0, 0), (3, 90), (120, 0), (70, 7)):
            texts.append("  ".join(some(before)) + "\t" + " ".join([*passage, *some(after)]))
    texts += [" ".join(some(r.randrange(300))) for _ in range(60)]
    texts += ["", None, " ".join(3 * some(30)), " ".join(some(20) * 6), texts[-1], " ".join(some(400))]
    rows = list(enumerate(texts))
    got = {x.doc_id: x for x in repeats.reported(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {k: x.n_passage_words for k, x in got.items()} == want
    assert any(want[k] and not x.n_removed for k, x in got.items())
