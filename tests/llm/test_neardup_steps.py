"""Few links go to the exact join at once; many ids are joined by shuffles."""

import random

from vellum.llm import neardup


def group_of(n):
    """n pairs, and the text that they were made from, in groups of more than PAIRS texts: a leader is near to one other text at most."""
    r = random.Random(5)
    parent = [f"w{i}" for i in range(1000)]
    texts = [" ".join(parent)]
    for i in range(n):
        one = list(parent)
        for at in (r.randrange(10, 290), r.randrange(310, 590)):
            one[at] = f"x{i}"
        other = list(one)
        other[r.randrange(700, 990)] = f"y{i}"
        texts += [" ".join(one), " ".join(other)]
    return texts


def classes_of(spark, texts):
    return {x.doc_id: x.class_id for x in neardup.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.985).collect()}


def test_no_round_looks_for_what_the_exact_join_finds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(neardup, "verified", lambda *given, call=neardup.verified: (calls.append(1), call(*given))[1])
    assert classes_of(spark, group_of(150)) == {0: 0} | {i: i - (i + 1) % 2 for i in range(1, 301)}
    assert len(calls) == 3  # leaders, one round of central texts, the exact join


def test_no_broadcast(spark, monkeypatch):
    """More ids than are broadcast: the same classes by shuffled joins."""
    monkeypatch.setattr(neardup, "SMALL", 10)
    assert classes_of(spark, group_of(40)) == {0: 0} | {i: i - (i + 1) % 2 for i in range(1, 81)}
