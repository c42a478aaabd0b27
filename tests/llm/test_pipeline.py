"""Every stage of the pipeline against a plain-Python version of it, each on the stage's own input; edge cases of whole runs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_packing import best_fit, valid
from test_rules import verdicts
from test_secrets import masked

from vellum.llm import packing
from vellum.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(max(2, int(r.gauss(5, 2))))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    texts = [prose(r.randrange(55, 160)) for _ in range(90)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:4]]  # the same words, other bytes
    texts += [t + f" more{i}" for i, t in enumerate(texts[:12])] + texts[:6] * 2
    texts += [prose(70) + ' password = "hunter22secret"', prose(60) + " user: joe pwd=hunter2x", prose(60) + " pwd=hunter2x", prose(3000) + " AKIA" + "B2" * 9]
    texts += ["too short", "same words here " * 60, "# $ % & " * 60, "", None, prose(60).upper()]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[8], "en", "a", 1), (None, prose(80), None, None, 1)]
    where = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    return str(where)


def distinct(rows):
    """One row of each class of near-duplicates, by comparing all pairs."""
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORD.findall(r[1] or "")) else None for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(bags):
        for j in range(i):
            if a and bags[j] and sum((a & bags[j]).values()) >= 0.8 * sum((a | bags[j]).values()) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i])
    return classes.values()


def mixed(rows):
    """Rows as often as the mix takes them: exponential keys by quality, whole epochs, then a budget; what ties is told apart by nothing."""
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r[3]].append(i)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in by[s]) for s in order}
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * total[s]}
        for s in full or free:
            target[s] = 2 * total[s] if full else level * weight[s]
            left -= target[s] if full else 0
        free -= full or free
    times = Counter()
    for s in order:
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        rest = math.floor(target[s] - epochs * total[s] + 0.5)

        def key(i):
            text = rows[i][1] or ""
            share = (len(text) - len(re.sub(r"[#*$%&|<>!]", "", text))) / max(1, len(text))
            u = (int(hashlib.md5(f"0|{'' if rows[i][0] is None else rows[i][0]}|{size[i]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / max(0.25, 1 - 5 * share), rows[i][0] is not None, rows[i][0] or 0, size[i]

        for i in sorted(by[s], key=key):
            taken = epochs * size[i] + max(0, min(size[i], rest))
            rest -= size[i]
            if size[i]:
                times[rows[i]] += math.floor(taken / size[i] + 0.5)
    return times


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = lambda df: [tuple(r) for r in df.collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "secret_scan", "source_mix", "best_fit_packing"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, done = plain(docs), stage(spark, docs, folder)
        rows = plain(done)
        if name != "best_fit_packing":
            assert done.columns == docs.columns
        if name == "quality_rules":
            told = verdicts([r[:4] for r in before])
            assert Counter(rows) == Counter(r for i, r in enumerate(before) if told[i]) and 0 < len(rows) < len(before)
        elif name == "near_dedup":
            classes = list(distinct(before))
            assert len(rows) == len(classes) < len(before)
            for held in classes:
                ids = [r[0] for r in held if r[0] is not None]
                assert sum(r in held for r in rows) == 1 and any(r in held and r[0] == min(ids, default=None) for r in rows)
        elif name == "secret_scan":
            assert Counter(rows) == Counter((i, masked(t), lang, s, k if masked(t) == t else len(masked(t))) for i, t, lang, s, k in before) and rows != before
        elif name == "source_mix":
            assert Counter(rows) == +mixed(before)
        else:
            ids = packing.Ids(tokenizer_path())
            want = Counter()
            for i, text, *_ in before:
                k = len(ids._slow(text or "")) + 1
                first = k % 2048 or 2048
                want.update((i, p, 0 if not p else first + 2048 * (p - 1), first if not p else 2048) for p in range(1 + (k - first) // 2048))
            got = done.collect()
            assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
            assert valid(got, 2048) <= best_fit([r.length for r in got], 2048) + 1
        if n < 4:
            done.write.parquet(f"{folder}/stage{n}")
            docs = spark.read.parquet(f"{folder}/stage{n}")


def test_empty_and_clashing(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = ("doc", "digest", "counts", "rates", "limits", "kept", "near_a", "near_words", "row", "parts", "spans", "size", "taken", "times", "rows", "nth", "again", "id", "words", "mix_n", "rule_base", "sec_id")
    clash = docs.withColumns({c: F.lit(c) for c in named})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, clash, folder)
        assert made.columns == clash.columns and made.where(" or ".join(f"{c} is null or {c} <> '{c}'" for c in named)).count() == 0
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and valid(rows, 2048)
