"""Queries without SQL, whole, against plain Python."""

import html
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.plans import intent
from vellum.plans.lifecycle import Store
from vellum.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def pieces(text, separators=("\n\n", "\n", " ", ""), size=1000, overlap=150):
    """Splits at the coarsest separator there is, keeps it at the head of what follows, and joins neighbours up to the size."""
    separator = next(s for s in separators if s in text)
    finer = separators[separators.index(separator) + 1 :]
    parts = re.split(f"(?={re.escape(separator)})", text) if separator else list(text)
    out, run = [], []

    def close(run):
        if "".join(run).strip():
            out.append("".join(run).strip())

    for part in filter(None, parts):
        if len(part) > size:
            close(run)
            run = []
            out.extend(pieces(part, finer, size, overlap) if finer else [part])
        elif len("".join(run)) + len(part) > size and run:
            close(run)
            while len("".join(run)) > overlap or (run and len("".join(run)) + len(part) > size):
                run = run[1:]
            run = [*run, part]
        else:
            run = [*run, part]
    close(run)
    return out


def test_split_recursive(spark):
    clean = lambda t: re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", re.sub(r"[ \t]+", " ", unicodedata.normalize("NFC", t)))).strip()
    told = {}
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        told.setdefault(clean(r.text or ""), []).append((r.doc_id, [len(p) for p in pieces(clean(r.text or ""))]))
    found = {}
    for r in QUERIES["split_recursive"](spark, DIR).orderBy("chunkIndex").collect():
        found.setdefault(r.sourceId, {}).setdefault(r.doc_id, []).append(r.n_chars)
    assert {d: n for of in found.values() for d, n in of.items()} == {d: n for of in told.values() for d, n in of if n}
    assert len(found) == sum(any(n for _, n in of) for of in told.values())


def test_html_sections(spark):
    """Each part from its tag to its own end, or that of an element around it."""
    told = []
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        tokens = re.findall(r"(?is)<!--.*?-->|<!.*?>|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>|[^<]+", r.html)
        kinds = [m[1].lower() if (m := re.match(r"<(/?\w+)", t)) else "" for t in tokens]

        def inside(i):
            open_, said = [], []
            for k, t in zip(kinds[i:], tokens[i:]):
                if k in ("script", "style") or t.startswith("<!"):
                    continue
                if k.startswith("/"):
                    if k[1:] in open_:
                        del open_[len(open_) - 1 - open_[::-1].index(k[1:]) :]
                    elif k[1:] in around(i):
                        open_ = []
                    if not open_:
                        break
                elif k and k not in ("br", "meta", "img", "hr", "link", "input"):
                    open_.append(k)
                elif not k:
                    said.append(html.unescape(t).strip())
            return " ".join(filter(None, said))

        def around(i):
            open_ = []
            for k in kinds[:i]:
                if k.startswith("/"):
                    if k[1:] in open_:
                        del open_[len(open_) - 1 - open_[::-1].index(k[1:]) :]
                elif k and k not in ("br", "meta", "img", "hr", "link", "input", "script", "style"):
                    open_.append(k)
            return open_

        name, held, out = None, [], []
        for i, k in enumerate(kinds):
            if k == "h1":
                if held:
                    out.append((name, "\n".join(held)))
                name, held = inside(i) or name, []
            elif k in ("p", "li") and inside(i):
                held.append(inside(i))
        told += [(r.page_id, i, *x) for i, x in enumerate([*out, (name, "\n".join(held))] if held else out)]
    found = sorted((r.page_id, r.ord, r.section or "", r.text) for r in QUERIES["html_sections"](spark, DIR).collect())
    assert found == sorted((p, i, s or "", t) for p, i, s, t in told)


def test_intent_model(spark):
    """The same objective, minimised by Newton's method on dense arrays."""
    rows = intent.training_rows(spark).collect()
    asked = [r.text for r in spark.read.parquet(f"{DIR}/conversations.parquet").where("role = 'user'").collect()]
    grams = lambda q: (w := re.findall(r"\w\w+", q.lower())) + [f"{a} {b}" for a, b in zip(w, w[1:])]
    vocabulary = sorted({g for r in rows for g in grams(r.query)})
    at, n = {g: i for i, g in enumerate(vocabulary)}, len(rows)
    df = np.zeros(len(at))
    for r in rows:
        for g in set(grams(r.query)):
            df[at[g]] += 1
    idf = np.log((1 + n) / (1 + df)) + 1

    def features(q):
        x = np.zeros(len(at))
        for g in grams(q):
            if g in at:
                x[at[g]] += 1
        x *= idf
        return x / (np.linalg.norm(x) or 1)

    classes = sorted({r.intent for r in rows})
    x, y = np.array([features(r.query) for r in rows]), np.array([classes.index(r.intent) for r in rows])
    weight = np.array([n / (len(classes) * (y == c).sum()) for c in y])
    weight /= weight.sum()
    w, b = np.zeros((len(classes), x.shape[1])), np.zeros(len(classes))
    for _ in range(20_000):
        p = np.exp(x @ w.T + b)
        p /= p.sum(1, keepdims=True)
        g = (p - np.eye(len(classes))[y]) * weight[:, None]
        w, b = w - 2.0 * (g.T @ x + w / n), b - 2.0 * g.sum(0)
    probability = np.exp(np.array([features(q) for q in asked]) @ w.T + b)
    probability /= probability.sum(1, keepdims=True)
    model = intent.IntentModel.fit(intent.training_rows(spark))
    found = model.predict(spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i long, query string")).orderBy("i").collect()
    assert [r.confidence for r in found] == pytest.approx(probability.max(1).tolist(), abs=2e-3)
    sure = [i for i, p in enumerate(probability) if np.sort(p)[-1] - np.sort(p)[-2] > 5e-3 and abs(p.max() - 0.3) > 5e-3]
    assert all(found[i].intent == (classes[probability[i].argmax()] if probability[i].max() >= 0.3 else "diger") for i in sure)


def test_credits_round_as_binary_values(spark):
    values = [i / 20 for i in range(400)] + [0.25, 0.35, 1.15, 2.675, 1e6 + 0.05, -0.25, -1.35, -0.04, 3.0, 0.0, 0.15, 12345678.95]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in rows.select(T.format_credit(F.col("v")).alias("s")).collect()] == [str(int(v)) if v.is_integer() else f"{v:.1f}" for v in values]


def test_uploads(spark, tmp_path):
    held = Store(spark, f"{tmp_path}/store")
    files = spark.createDataFrame([("a b.txt", b"Some text of a course"), ("copy.txt", b"Some text of a course"), ("c.md", b"# Head\nbody of it"), ("d.exe", b"no"), ("none", b"no")], "name string, content binary")
    n, report = held.upload(files)
    assert n == 2 and {r.name: r.accepted for r in report.collect()} == {"a b.txt": True, "copy.txt": True, "c.md": True, "d.exe": False, "none": False}
    keys = {r.name: r.storageKey for r in report.collect()}
    assert keys["a b.txt"] == keys["copy.txt"] and keys["d.exe"] is None
    assert [bytes(r.content) for r in held.raw(keys["c.md"]).collect()] == [b"# Head\nbody of it"]
    held.upload(files)
    assert spark.read.parquet(f"{tmp_path}/store/files").count() == 2 and held.read("sources").count() == 2
    assert held.upload(files.where("name = 'd.exe'"))[0] == 0


def test_course_seed_is_for_an_empty_table(spark, tmp_path):
    held = Store(spark, f"{tmp_path}/store")
    assert held.seed_courses(f"{tmp_path}/none") == 6 and held.seed_courses(f"{tmp_path}/none") == 0
    assert tuple(held.read("courses").where("code = 'CS 307'").select("subject", "number", "title", "su_credits").first()) == ("CS", "307", "Operating Systems", "3")
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "all_coursepage_info.jsonl").write_text('{"course_id": "CS101", "title": "Intro"}\n{"course_id": "", "title": "x"}\n')
    other = Store(spark, f"{tmp_path}/other")
    assert other.seed_courses(f"{tmp_path}/pages") == 1 and other.read("courses").first().code == "CS 101"


def test_a_users_courses_are_replaced(spark, tmp_path):
    held = Store(spark, f"{tmp_path}/store")
    held.seed_courses(f"{tmp_path}/none")
    asked = lambda *codes: spark.createDataFrame([(c,) for c in codes], "code string")
    assert held.set_courses("a", asked("CS 300", "CS 302", "CS 300", "XX 1")) == 2 and held.set_courses("b", asked("CS 300")) == 1
    assert held.set_courses("a", asked("CS 455")) == 1
    assert sorted((r.username, r.code) for r in held.read("user_courses").collect()) == [("a", "CS 455"), ("b", "CS 300")]
    assert held.set_courses("a", asked()) == 0 and held.read("user_courses").count() == 1
