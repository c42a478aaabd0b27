"""The adaptive verdict against plain Python, on groups of many and of few texts, and on copies that must not set a group's limits."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vellum.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    letters = {"en": "etaoinshrdlu", "de": "enisratdhulcg", None: "aeiou"}

    def prose(lang, n, size):
        return " ".join("".join(r.choice(letters[lang]) for _ in range(max(1, int(r.gauss(size, 2))))).capitalize() if r.random() < 0.1 else "".join(r.choice(letters[lang]) for _ in range(max(1, int(r.gauss(size, 2))))) for _ in range(n)) + "."

    out = []
    for lang, source, n, size in (("en", "a", 250, 5), ("en", "b", 12, 5), ("de", "a", 120, 7), (None, None, 30, 5), ("en", None, 3, 6)):
        out += [(lang, source, prose(lang, r.randrange(50, 200), size)) for _ in range(n)]
    out += [("en", "a", "# $ % " * 3 + prose("en", 80, 5).replace("e", "#")) for _ in range(8)]
    out += [("de", "a", prose("de", 90, 14)), ("en", "b", prose("en", 90, 2)), ("en", "b", prose("en", 70, 5).upper())]
    out += [("en", "copies", prose("en", 100, 5))] * 90 + [("en", "copies", prose("en", 100, 5.2)) for _ in range(4)]
    out += [("en", "a", prose("en", 20000, 5)), ("en", "a", "same words here " * 40), ("en", "a", ""), ("en", "a", None), ("fr", "only short", "one two three")]
    return [(i, text, lang, source) for i, (lang, source, text) in enumerate(out)]


def rates(text):
    words = WORD.findall(text)
    chars = max(1, sum(map(len, words)))
    return {
        "word_size": sum(map(len, words)) / max(1, len(words)), "marks": sum(not c.isalnum() for w in words for c in w) / chars,
        "capitals": sum(c.isupper() for w in words for c in w) / chars, "short": sum(len(w) <= 3 for w in words) / max(1, len(words)),
    }


def fails(text):
    w = WORD.findall(text)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    seen = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w) < 50 or 100 * len(seen) > 50 * len(w)


def verdicts(rows):
    """Row number to whether rows (id, text, lang, source) are kept, in plain Python."""
    good = [(lang, source, text) for lang, source, text in {(lang, source, text or "") for _, text, lang, source in rows} if not fails(text)]

    def quartiles(values):
        values = sorted(0.0 if v < rules.LEAST else math.exp(math.ceil(math.log(v) / math.log(rules.GROWTH)) * math.log(rules.GROWTH)) for v in values)
        return [values[math.ceil(len(values) * p) - 1] for p in (0.25, 0.75)], len(values)

    by = defaultdict(list)
    for lang, source, text in good:
        for k, v in rates(text).items():
            for key in ((k,), (k, lang), (k, lang, source)):
                by[key].append(v)

    def limits(k, lang, source):
        whole, _ = quartiles(by[(k,)])
        now = whole
        for key in ((k, lang), (k, lang, source)):
            own, n = quartiles(by[key])
            now = [n / (n + rules.PRIOR) * a + rules.PRIOR / (n + rules.PRIOR) * b for a, b in zip(own, now)]
        apart = rules.FENCE * max(now[1] - now[0], (whole[1] - whole[0]) / 2)
        return (now[0] - apart, now[1] + apart) if apart > 0 else (-math.inf, math.inf)

    want = {}
    for n, (_, text, lang, source) in enumerate(rows):
        ok = not fails(text or "")
        for k, v in rates(text or "").items() if ok else ():
            low, high = limits(k, lang, source)
            ok = ok and low <= v <= high
        want[n] = ok
    return want


def test_kept(spark, rows):
    want = verdicts(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in rules.verdicts(table).collect()}
    assert got == want and 8 < sum(not v for v in want.values()) < 40
    clash = table.withColumns({c: F.lit(i) for i, c in enumerate(("doc", "digest", "counts", "base", "rates", "limits", "kept", "salt", "rule_limits"))})
    kept = rules.passed(clash)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i, k in want.items() if k}
    assert all((r.doc, r.salt, r.rule_limits) == (0, 7, 8) for r in kept.collect())


def test_many_groups(spark, rows, monkeypatch):
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted(map(str, rules.verdicts(table).collect()))
    monkeypatch.setattr(rules, "SMALL", 2)
    assert sorted(map(str, rules.verdicts(table).collect())) == want
