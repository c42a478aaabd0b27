"""Operators against brute force on small tables, and edge cases: nulls, empty texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum.llm import chat, licenses, mixing, neardup, packing, quality, repeats, rules, secrets, vectors
from vellum.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["alpha", "béta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "a", "b#", "CC", "BY"]
    out = [" ".join(r.choice(words) for _ in range(r.randrange(1, 150))) for _ in range(60)]
    out += [t.replace("zeta", "iota", 1) for t in out[:15]] + out[:5]
    out += ["", " \n ", None, "x", "CC BY-NC.\nAll rights reserved. SPDX-License-Identifier: (MIT OR GPL-2.0) AND cc-by", "password=hunter22 and AKIA" + "A1" * 9, "le\nle\n\nle", "<|endoftext|> [x] \\ </s>"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, None, None, None, None)]
    # columns whose names operators use themselves
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "size", "start", "kind", "length", "rank", "label")}).cache()


def test_rules(docs):
    got = {r.doc_id: r for r in rules.verdicts(docs).collect()}
    for d in docs.collect():
        x, r = d.text or "", got[d.doc_id]
        w = WORD.findall(x)
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        seen = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [a for a in x.split("\n") if WORD.search(a)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(seen))
        assert r.base_failed == (len(w) < 50 or 100 * len(seen) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rules.passed(docs).count() == sum(r.kept for r in rules.verdicts(docs).collect())


def test_mixing(docs):
    rows = mixing.sampled(docs).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mixing.sampled(docs.repartition(7)).collect()))
    taken, goal = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        goal[r.source] = (r.target, r.source_size)
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 1 and t <= 2 * n for s, (t, n) in goal.items())
    assert abs(sum(t for t, _ in goal.values()) - 1.5 * sum(n for _, n in goal.values())) < 1e-6
    assert mixing.mix(docs).columns == docs.columns


def test_repeats(spark, docs):
    span, rows = 40, docs.collect()
    n = Counter(b[i : i + span] for d in rows for b in [(d.text or "").encode()] for i in range(len(b) - span + 1))
    want = []
    for d in rows:
        b = (d.text or "").encode()
        gone = {j for i in range(len(b) - span + 1) if n[b[i : i + span]] > 1 for j in range(i, i + span)}
        kept = bytes(c for i, c in enumerate(b) if i not in gone)
        want.append((d.doc_id, len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, repeats.removed(docs, span).drop("n_kept", "repeated").collect()), key=str) == sorted(want, key=str)


def test_neardup(docs):
    bags = {}
    for d in docs.collect():
        w = WORD.findall(d.text or "")
        bags[d.doc_id] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
    root = {k: k for k in bags}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    known = sorted(k for k in bags if bags[k])
    for i, a in enumerate(known):
        for b in known[:i]:
            if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = neardup.assign(docs).collect()
    assert len(rows) == docs.count() and all(r.class_id == find(r.doc_id) for r in rows)
    kept = neardup.distinct(docs)
    assert kept.columns == docs.columns and len([r for r in kept.collect() if WORD.search(r.text or "")]) == len({find(k) for k in known})


def test_neardup_without_ids(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:-1], "x"])
    other = [f"o{i}" for i in range(100)]
    rows = [(7, " ".join(words)), (None, near), (None, near), (None, " ".join(other)), (None, " ".join([*other[:-1], "x"])), (9, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in neardup.assign(docs).collect()), key=str)
    assert got == sorted([(7, 7, 3), (None, 7, 3), (None, 7, 3), (None, None, 2), (None, None, 2), (9, 9, 1)], key=str)
    kept = [tuple(r) for r in neardup.distinct(docs).collect()]
    assert len(kept) == 3 and set(kept) >= {rows[0], rows[5]}


def test_neardup_in_a_large_group(spark):
    """Pairs that are near to each other alone, in band groups of more than PAIRS texts: few share a smaller group."""
    r = random.Random(5)
    parent = [f"w{i}" for i in range(1000)]
    texts = [" ".join(parent)]
    for i in range(150):
        one = list(parent)
        for at in (r.randrange(10, 290), r.randrange(310, 590)):
            one[at] = f"x{i}"
        other = list(one)
        other[r.randrange(700, 990)] = f"y{i}"
        texts += [" ".join(one), " ".join(other)]
    bags = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    near = [(a, b) for b in range(len(bags)) for a in range(b) if len(bags[a] & bags[b]) >= 0.985 * len(bags[a] | bags[b])]
    assert near == [(i, i + 1) for i in range(1, 301, 2)]
    got = {x.doc_id: x.class_id for x in neardup.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.985).collect()}
    assert got == {0: 0} | {i: i - (i + 1) % 2 for i in range(1, 301)}


def test_secrets(docs):
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    for d in docs.collect():
        x, found = d.text or "", []
        found += [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", x, re.I | re.A) if len(m[1]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        assert got[d.doc_id].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    after = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert len(after) == len(got) and not any("hunter22" in (t or "") for t in after.values())


def test_weak_parts_need_company(spark):
    rows = [(1, "user: joe pwd=hunter2x"), (2, "user: joe"), (3, "pwd=hunter2x"), (4, "https://x.y/z " + "w " * 300 + "pwd=hunter2x")]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "identifier:0:9,key:10:22", 2: "", 3: "", 4: ""}


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|end|> [x] \\<"), (1, 1, "assistant", None), (1, 2, "assistant", "</s>ok"), (2, 0, None, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("content", chat.text_part(F.col("text")))
    done = chat.conversations(turns)
    got = {r.conv_id: r for r in done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hi <|end|> [x] \\<"), ("assistant", ""), ("assistant", "</s>ok")] and got[1].loss == "</s>ok"
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and "</s>" not in got[1].formatted
    parts = [(1, 0, "user", [("text", "see", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 1.5, None)])]
    done = chat.conversations(spark.createDataFrame(parts, f"conv_id long, turn long, role string, content array<{chat.PART}>")).first()
    assert "see<|image:1|><|audio:2|>" in done.formatted and done.attachment_tokens == 4 + 38 and [a.uri for a in done.attachments] == ["i.png", "a.wav"]


def test_quality_on_held_out(spark):
    where = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{where}/labels.parquet").select("doc_id", "quality")
    got = quality.classified(spark.read.parquet(f"{where}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for made in (licenses.scan, rules.verdicts, rules.passed, mixing.sampled, mixing.mix, repeats.removed, neardup.assign, neardup.distinct, secrets.scan, secrets.redacted):
        assert made(none).count() == 0, made
    assert packing.pack(none, tokenizer_path()).count() == 0
    assert quality.classified(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert vectors.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0
