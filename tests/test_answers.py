"""Rules from question to prompt, and the life of sources, batches and chunks."""

import pytest
from pyspark.sql import functions as F

from vellum.__main__ import main
from vellum.plans import answers, catalog, lifecycle
from vellum.plans.lifecycle import Store

QUESTIONS = [
    ("Mezuniyet için kaç kredi kaldı?", "x", "mezuniyet_durumu", None), ("CS412 kim veriyor", "x", "ders_ayrintisi", None), ("CS 412 için kredi", "x", "ders_ayrintisi", None), ("CS412 mezuniyet", "x", "mezuniyet_durumu", None),
    ("CS412 schedule", "x", "ders_onerisi", None), ("Sınavlarına NASIL hazırlanılır", "x", "calisma_plani", None), ("hangi bölüm iyi", "x", "major_secimi", None), ("uzmanlaşmak istiyorum", "x", "alanda_ozellesme", None),
    (" NLP ", "x", "ders_onerisi", "nlp"), ("machine learning nedir", "x", "x", "ai"), ("web ve data", "", "ders_onerisi", "data"), ("zorunlu mu", "x", "ders_onerisi", None), ("merhaba", "", "diger", None), (None, None, "diger", None),
]


def test_resolution(spark):
    rows = spark.createDataFrame([(i, q, d) for i, (q, d, _, _) in enumerate(QUESTIONS)], "i int, q string, d string")
    got = rows.select("i", answers.resolve(F.col("q"), F.col("d")).alias("intent"), answers.interest(F.col("q")).alias("area")).orderBy("i").collect()
    assert [(r.intent, r.area) for r in got] == [(intent, area) for _, _, intent, area in QUESTIONS]


def test_expansion_and_cards(spark):
    taken = F.array(F.lit("CS 445"), F.lit("cs412"))
    row = spark.range(1).select(
        answers.retrieval_query(F.lit("nlp"), F.lit("ders_onerisi")).alias("short"), answers.retrieval_query(F.lit("q"), F.lit("exam")).alias("exam"), answers.retrieval_query(F.lit("q"), F.lit("diger")).alias("same"),
        answers.intent_context(F.lit("ders_onerisi"), taken).alias("advice"), answers.intent_context(F.lit("odd"), taken).alias("other"), answers.strategy(F.lit("nlp"), taken).alias("plan"), answers.strategy(F.lit("hm"), taken).alias("none"),
        answers.scrub(F.lit(" Öncelikle mezuniyet durumunu inceledim. İşte liste")).alias("clean"), answers.recommendation_question(F.lit("web?"), F.lit(None).cast("array<string>")).alias("asked"),
    ).first()
    assert row.short.startswith("NLP alanında gelecek dönem için 5 derslik ders programı öner.") and "Kullanıcının ilgi ayrıntısı: nlp CS445 CS455 CS412" in row.short and " 202502 AI NLP Data Web Systems Security" in row.short
    assert row.exam == "q exam final midterm quiz past questions solutions assessment" and row.same == "q"
    assert "strictly forbidden to recommend: CS 445, cs412." in row.advice and row.other == "[Source: Request intent]\nDetected intent: odd. Answer only this academic intent using the retrieved context."
    assert "hints for this area: CS 445, CS 455, CS 412," in row.plan and "never recommend again: CS 445, CS 412.\n" in row.plan and row.none is None
    assert row.clean == "İşte liste" and "interest area: Web." in row.asked and "any of these: none." in row.asked


def test_candidates(spark):
    lines = [
        ("202502/CS.jsonl", 1, '{"Major": "CS", "Code": "412", "Course_Name": "old", "EL_Type": "core"}'), ("202502/CS.jsonl", 2, '{"Major": "CS", "Code": 412, "Course_Name": "ML", "EL_Type": "area", "SU_credit": 3, "ECTS": 6}'),
        ("schedule/202502.jsonl", 1, '{"course_id": "CS 455", "title": "NLP", "crn": 7, "section": "A", "meetings": [{"days": "M", "time": "9:40", "instructors": "Ann ( P )"}, {"instructors": "Ann"}]}'),
        ("schedule/202502.jsonl", 2, '{"course_id": "CS455", "title": "late", "section": "B"}'), ("schedule/202502.jsonl", 3, '{"course_id": "CS455", "section": "C"}'),
    ]
    rows = spark.createDataFrame(lines, "source_path string, line_no int, line string").withColumn("v", F.parse_json("line"))
    got = answers.candidates(spark, "nlp", ["cs 412"], *answers.term_rows(rows)).orderBy("position").collect()
    assert [(r.code, r.status) for r in got] == [("CS 455", "eligible_candidate"), ("CS 412", "already_taken_do_not_recommend")]
    assert got[0].text == "[Source: CS recommendation candidate CS 455]\nCourse: CS 455 - NLP\nRecommendation status: eligible_candidate\nSchedule 202502: section A; CRN 7; instructor(s): Ann; meetings: M 9:40 | section B\n"
    assert "Course: CS 412 - ML\n" in got[1].text and "category: area\nSU credits: 3\nECTS: 6\nfaculty: None\nSchedule 202502: not found in loaded schedule context\n" in got[1].text


def test_profiles_and_context(spark):
    users = spark.createDataFrame([("ann",), ("bob",)], "username string")
    taken = spark.createDataFrame([("ann", "EE 1", "b", "EE", "1", "2.5", None, None, "1"), ("ann", "CS 1", "a", "CS", "1", "3", "6", None, None), ("ann", "CS 2", "c", "CS", "2", "n/a", None, None, None)], "username string, code string, title string, subject string, number string, su_credits string, ects string, engineering_ects string, basic_science_ects string")
    got = {r.username: r for r in answers.profiles(users, taken).collect()}
    assert (got["ann"].total, got["ann"].remaining, got["ann"].n, got["bob"].n, got["bob"].remaining) == (5.5, 119.5, 3, 0, 125.0)
    assert "\n- CS 1 - a; SU credits 3; ECTS 6\n- CS 2 - c; SU credits n/a\n- EE 1 - b; SU credits 2.5; basic science ECTS 1\n" in got["ann"].profile and "total from MongoDB: 5.5/125 SU" in got["ann"].profile
    assert got["ann"].compact.endswith("\n- CS 1 - a (SU 3)\n- CS 2 - c (SU n/a)\n- EE 1 - b (SU 2.5)") and got["bob"].profile.startswith("User profile: bob. No completed")
    one = lambda *rows: spark.createDataFrame(list(rows), "position int, source string, text string")
    context = answers.assemble(one((0, "Request intent", "i")), one((1, "b", "y"), (0, "a", "x")), one((0, "b", "z"), (1, "", "w")))
    assert [r.text for r in context.orderBy("position").collect()] == ["i", "x", "y", "z", "w"] and answers.cited(context) == ["Request intent", "a", "b"]


def test_life_of_sources(spark, tmp_path):
    files, held = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    (files / "exams").mkdir(parents=True)
    (files / "a.txt").write_text("hello")
    (files / "b.md").write_text("# One\nx\n# Two\ny")
    (files / "copy.txt").write_text("hello")
    (files / "exams" / "e.txt").write_text("question")
    assert main(["--store", held.root, "files", str(files)], spark) == {"chunks": 4}
    assert held.ingest_files(str(files), "course", excluded={"exams"}) == 3
    sources = held.read("sources").orderBy("fileName").collect()
    assert [(r.fileName, r.status, r.chunksCreated, r.type) for r in sources] == [("a.txt", "indexed", 1, "course"), ("b.md", "indexed", 2, "course"), ("e.txt", "indexed", 1, "course")]
    assert held.read("jobs").where("status = 'indexed' and finishedAt is not null").count() == 5 and held.read("chunks").count() == 4
    exam = held.ingest_exam(str(files / "exams" / "e.txt"), " cs412 ", "2024", "Fall", " FINAL ")
    assert exam["chunks"] == 1 and [(r.courseCode, r.examType) for r in held.read("exams").collect()] == [("CS412", "final")]
    report = held.delete_source(exam["sourceId"])
    assert report["deletedChunks"] == 1 and report["exams"] == 1 and held.read("exams").first().status == "deleted" and held.read("chunks").count() == 4
    assert held.read("sources").where("status = 'deleted' and deletedAt is not null").count() == 1
    with pytest.raises(ValueError, match="Source not found"):
        held.delete_source("none:1")


def test_life_of_batches(spark, tmp_path):
    held, chat = Store(spark, str(tmp_path / "store")), tmp_path / "chat.txt"
    chat.write_text("1.2.24, 9:05 - Ann: hi a@b.co\nmore\n1.2.24, 9:06 - Bob: yo\n")
    batch = held.create_batch(str(chat))
    assert (batch["messageCount"], batch["preview"], batch["status"]) == (2, ["hi [redacted] more", "yo"], "pending") and held.read("reviews").count() == 0
    created = held.read("batches").first().createdAt
    assert held.confirm_batch(batch["batchId"], approved=False)["status"] == "rejected" and held.read("sources").first().status == "rejected"
    for _ in range(2):
        assert held.confirm_batch(batch["batchId"])["chunks"] == 1
    row = held.read("batches").first()
    assert (row.status, row.chunksCreated, row.createdAt, row.preview) == ("indexed", 1, created, batch["preview"])
    assert held.read("reviews").count() == 2 and held.read("chunks").first().text == "hi [redacted] more\nyo" and held.read("sources").first().status == "indexed"
    with pytest.raises(ValueError, match="not found"):
        held.confirm_batch("whatsapp:none")


def test_catalog_command(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "terms.jsonl").write_text('{"term": "202502", "majors": ["CS"]}\n')
    held = Store(spark, str(tmp_path / "store"))
    assert main(["--store", held.root, "catalog", str(tmp_path / "c"), "--dry-run"], spark) == {"available_term": 1, "available_terms_summary": 1} and held.read("chunks").count() == 0
    assert held.ingest_catalog(str(tmp_path / "c")) == 2 and held.read("chunks").count() == 2 and catalog.ORDER


def test_retrieval_steps(spark):
    from vellum.plans import retrieve

    asked = retrieve.asked(spark, "CS 412 required section 202502")
    base = {"document_type": ["schedule_section", "schedule_course_list"], "term_code": ["202502"], "program": ["CS"]}
    full = base | {"requirement_type": ["required"]}
    assert retrieve.steps(asked) == [full | {"course_id": "CS 412"}, base | {"course_id": "CS 412"}, full]
    assert retrieve.steps(retrieve.asked(spark, "hello"), {"documentType": "course"}) == [{"documentType": "course"}] and retrieve.steps(retrieve.asked(spark, "hello")) == []
    assert retrieve.steps(retrieve.asked(spark, "program of CS"))[0]["aggregate"] is True
    rows = spark.createDataFrame([("a", "alpha", [0.0, 1.0], "course"), ("b", "beta hello", [1.0, 0.0], "course"), ("c", "hello", [0.0, 0.9], "exam"), ("d", "hello", None, "exam")], "chunk_id string, text string, embedding array<float>, documentType string")
    got = retrieve.retrieve(rows, "hello", [0.0, 1.0], 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("c", 0.25), ("a", 0.0)]
    both = retrieve.retrieve_types(rows, "hello", [0.0, 1.0], ["exam", "course"]).orderBy("position").collect()
    assert [r.chunk_id for r in both] == ["c", "d", "b", "a"]
    top = retrieve.rerank(retrieve.retrieve(rows, "hello", [0.0, 1.0], 4), "hello", F.length("text"), 2).collect()
    assert [(r.chunk_id, r.combined_rerank_score) for r in top] == [("b", 10.0), ("c", 5.0)]
    assert retrieve.retrieve(rows.limit(0), "hello", [0.0, 1.0]).count() == 0


def test_batches_and_citations_as_tables(spark):
    rows = [("a", i, f"t{i}") for i in range(11)] + [("b", 0, "only"), (None, 0, "x")]
    told = {r.k: r for r in lifecycle.summaries(spark.createDataFrame(rows, "k string, index long, text string").repartition(3), ["k"]).collect()}
    assert told["a"].messageCount == 11 and told["a"].preview == [f"t{i}" for i in range(8)] and told["a"].text == "\n".join(f"t{i}" for i in range(11))
    assert (told["b"].messageCount, told["b"].preview, told["b"].text) == (1, ["only"], "only") and told[None].text == "x"
    none = lifecycle.summaries(spark.createDataFrame([], "index long, text string"), []).first()
    assert (none.messageCount, none.preview, none.text) == (0, [], "")
    context = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (1, 3, ""), (1, 4, None), (2, 0, None), (None, 0, "c")], "q long, position int, source string")
    many = {r.q: r.labels for r in answers.cited_many(context, ["q"]).collect()}
    assert many == {1: ["b", "a"], 2: [], None: ["c"]} and answers.cited(context.where("q = 1")) == many[1]
