import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import retrieval, store
from vellum.operators.chunking import split_text
from vellum.plans import intent
from vellum.sources import documents as sources


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_scalars(spark):
    got = one(
        spark,
        term=T.term_name(F.lit("202502")), odd=T.term_name(F.lit("202509")), none=T.term_name(F.lit("2025")),
        days=T.readable_days(F.lit("tR.X")), course=T.spaced_course_id(F.lit("cs412")), kept=T.spaced_course_id(F.lit("412")),
        number=T.number_of(F.lit("CS 412")), file=T.safe_filename(F.lit("a/b c?.txt")), nothing=T.safe_filename(F.lit("")),
        pii=T.redact(F.lit("mail a.b@c.de or +90 555 123 45 67!")), kind=T.document_type(F.lit(None).cast("string")), review=T.document_type(F.lit("WhatsApp")),
        label=T.source_label(F.lit("a.pdf"), F.lit(3), F.lit(None), F.lit("Intro")), place=T.location_key(F.lit(None), F.lit(4), F.lit("x")),
        req=T.requirement_type(F.lit("Core Electives")), other=T.requirement_type(F.lit("")), credit=T.format_credit(F.lit(2.5)), whole=T.format_credit(F.lit(3.0)),
        clean=T.clean_text(F.lit("a b  c \r\n\r\n\r\n\r\nd​")), value=T.clean_value(F.lit("3.0")), truth=T.clean_value(F.lit("true")), half=T.clean_value(F.lit("2.5")),
    )
    assert got == {
        "term": "Spring 2025-2026 (Bahar)", "odd": "Unknown 2025-2026 (Unknown)", "none": "", "days": "Tuesday/Thursday/X", "course": "CS 412", "kept": "412", "number": "412",
        "file": "b_c_.txt", "nothing": "upload.txt", "pii": "mail [redacted] or [redacted]!", "kind": "course", "review": "review", "label": "a.pdf, page 3, section 'Intro'", "place": "s4",
        "req": "core", "other": "unknown", "credit": "2.5", "whole": "3", "clean": "ab c\n\nd", "value": "3", "truth": "True", "half": "2.5",
    }


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400))
def test_split_keeps_the_text(text):
    pieces = split_text(text, 50, 10)
    assert all(0 < len(p) <= 50 for p in pieces)
    assert set("".join(text.split())) == set("".join("".join(pieces).split()))
    assert all(p in text for p in pieces)


def test_split_overlaps():
    pieces = split_text(" ".join(f"w{i:03}" for i in range(100)), 50, 15)
    assert all(a.split()[-1] in b.split() for a, b in zip(pieces, pieces[1:]))


def test_sections(spark):
    docs = spark.createDataFrame([("a", "intro\n# One\nx\n#\ny\n## Two\n"), ("b", "# only"), ("c", "")], "path string, text string")
    got = {(r.path, r.section, r.text) for r in sources.markdown(docs).collect()}
    assert got == {("a", None, "intro"), ("a", "One", "x"), ("a", "One", "y"), ("b", None, "# only")}


def test_notebook_and_json(spark):
    book = '{"cells": [{"cell_type": "markdown", "source": ["# T\\n", "more"]}, {"cell_type": "code", "source": "x = 1"}, {"cell_type": "raw", "source": ""}]}'
    got = sources.notebook(spark.createDataFrame([("n", book)], "path string, text string")).collect()
    assert [(r.section, r.text) for r in got] == [("T", "more\n\nCode example:\nx = 1")]
    many = "[" + ",".join(map(str, range(30))) + "]"
    got = sources.json_groups(spark.createDataFrame([("j", many)], "path string, text string")).orderBy("ord").collect()
    assert [r.section for r in got] == ["items 1-25", "items 26-30"]


def test_html_nests_twice():
    assert sources.html_records("<script>x</script><h1>T</h1><li><p>a</p></li>") == [("T", "a\na")]
    assert sources.html_records("<div>only</div>") == [(None, "only")]


def test_office_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t, style="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{para("before")}{para("Head", "Heading1")}{para("after")}</w:body></w:document>')
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", f'<s xmlns:a="{a}"><a:p><a:r><a:t>one</a:t></a:r><a:r><a:t> two</a:t></a:r></a:p></s>')
    (tmp_path / "c.txt").write_bytes(b" plain \xff ")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "d.txt").write_text("no")
    got = {(r.path.rsplit("/", 1)[1], r.text, r.slide, r.section) for r in sources.load(sources.files(spark, str(tmp_path), excluded={"SKIP"})).collect()}
    assert got == {("a.docx", "before", None, None), ("a.docx", "after", None, "Head"), ("b.pptx", "one two", 1, None), ("c.txt", "plain �", None, None)}


def test_chat(spark):
    text = "lost line\n1.2.24, 9:05 PM - Ann: hi a@b.co\nmore\n[1.2.2024 10:15:01] Bob: yo\n1.2.24, 9:06 - Ann: \n"
    rows = sources.chat(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).orderBy("index").collect()
    assert [(r["index"], r.author, r.time, r.text) for r in rows] == [(0, "", "", "lost line"), (1, "Ann", "9:05", "hi [redacted] more"), (2, "Bob", "10:15", "yo"), (3, "", "9:06", "Ann:")]


def test_jsonl_counts_blank_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    got = sources.jsonl(spark, str(tmp_path / "x.jsonl"), "a int").orderBy("line_no").collect()
    assert [(r.line_no, r.row.a) for r in got] == [(1, 1), (3, 2)]


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, v string, created int")
    new = spark.createDataFrame([(2, "c", 99), (3, "d", 30)], "id int, v string, created int")
    assert sorted(map(tuple, store.upsert_keeping(old, new, ["id"], ["created"]).collect())) == [(1, "a", 10), (2, "c", 20), (3, "d", 30)]
    once = store.upsert(old, new, ["id"], ["created"])
    assert sorted(once.collect()) == sorted(store.upsert(once, new, ["id"], ["created"]).collect())
    parents, children = store.cascade_delete(old.withColumn("status", F.lit("ok")), {"kids": new.select("id")}, "id", new.where("id = 2"))
    assert {(r.id, r.status) for r in parents.collect()} == {(1, "ok"), (2, "deleted")} and [r.id for r in children["kids"].collect()] == [3]


def test_rerank_is_stable(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(6)], "i int, s int")
    assert [r.i for r in retrieval.rerank(rows, F.col("s"), 4, ["i"]).collect()] == [1, 3, 5, 0]


def test_intent(spark):
    got = one(spark, t=intent.term_codes(F.lit("202401 Fall 2024-2025 202401")), c=intent.course_ids(F.lit("cs-412, CS 412 and ee200L")), p=intent.programs(F.lit("psir or cs")), r=intent.requirement_types(F.lit("zorunlu area")), d=intent.document_types(F.lit("kredi")), route=intent.route(F.lit("SINAV yorumları"), F.lit("diger"))["intent"])
    assert got["t"] == ["202401"] and got["c"] == ["CS 412", "EE 200L"] and got["p"] == ["PSIR", "CS"] and got["r"] == ["required", "area"] and len(got["d"]) == 10 and got["route"] == "exam"
    rows = intent.training_rows(spark)
    known = intent.IntentModel.fit(rows).predict(rows.withColumnRenamed("intent", "truth"), threshold=0.0).collect()
    assert sum(r.intent == r.truth for r in known) >= 0.9 * len(known) and all(0 <= r.confidence <= 1 for r in known)


def test_stream(spark, tmp_path):
    from vellum.streaming.ingest import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello stream")
    seen = []
    follow(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda rows, n: seen.extend(rows.collect())).awaitTermination(60)
    assert [(r.chunk, r.chunkIndex) for r in seen] == [("hello stream", 0)]
