"""Tables of questions meet texts in packs: results as one by one, and equal vectors searched once."""

import random

from pyspark.sql import functions as F

from vellum.operators import cells
from vellum.plans import retrieve


def test_questions_in_packs(spark, monkeypatch):
    rows = [(f"c{i:02}", f"text {i} about {'required' if i % 2 else 'core'} courses", [float(i % 7), float(i % 3)], ["CS 101", "EE 204", None][i % 3], ["required", "core"][i % 2], "CS", "program_requirement") for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, embedding array<double>, course_id string, requirement_type string, program string, document_type string")
    asked = ["required CS 101", "text 7 ours", "required CS 101", "CS 101 required 12 out", "required CS 101 text 9"] * 4
    questions = spark.createDataFrame([(i, q, [1.0, 2.0 if i % 5 else 1.0]) for i, q in enumerate(asked)], "question_id long, question string, vector array<double>")
    searched, nearest = [], cells.nearest
    monkeypatch.setattr(cells, "nearest", lambda points, probes, k: (searched.append(probes.count()), nearest(points, probes, k))[1])
    monkeypatch.setattr(retrieve, "PACK", 3)
    many = {}
    for r in retrieve.retrieve_many(chunks, questions, 5).collect():
        many.setdefault(r.question_id, []).append((r["rank"], r.chunk_id, r.score))
    assert searched == [6, 1]  # three conditions with two vectors, of 48 steps; one vector of four questions without a step
    for i in range(5):
        one = [(r["rank"], r.chunk_id, r.score) for r in retrieve.retrieve(chunks, asked[i], [1.0, 2.0 if i % 5 else 1.0], 5).collect()]
        assert sorted(many[i]) == one and all(sorted(many[i + j]) == one for j in (5, 10, 15))


def test_terms_in_a_text(monkeypatch):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choices("ab1", k=draw.randint(1, n)))
    for parts in (0, 1, 20):
        monkeypatch.setattr(retrieve, "PARTS", parts)
        for _ in range(50):
            terms = list({word(4) for _ in range(draw.randint(0, 30))} | {""})
            look = retrieve._lookup(terms)
            for _ in range(4):
                text = "".join(draw.choice((word(9), " ", "é-", "\n")) for _ in range(draw.randint(0, 9)))
                assert look(text).tolist() == [float(t != "" and t in text) for t in terms]


def test_tags_are_worth_the_metadata_score(spark):
    from vellum.operators import retrieval

    rows = [(c, t, p, r, a, g, asked, grad) for c in ("CS 101", None) for t in ("202502",) for p in ("CS", "EE") for r in ("core", None) for a in ("official_degree_evaluation", "official_degree_requirements", None) for g in (True, False, None) for asked in (["CS 101"], []) for grad in (True, False)]
    kind = "course_id string, term_code string, program string, requirement_type string, source_authority string, aggregate boolean, courses array<string>, graduation boolean"
    both = spark.createDataFrame(rows, kind).withColumns({"terms": F.array(F.lit("202502")), "programs": F.array(F.lit("EE")), "requirements": F.array(F.lit("core"))})
    for r in both.select(retrieval.structured_scores().alias("score"), retrieval.tags().alias("tags"), retrieval.worths().alias("worths")).collect():
        assert r.score == sum(w.weight for w in r.worths if w.tag in r.tags)
