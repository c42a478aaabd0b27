"""Late interaction in packs: scores as the columns give them, and tokens compared once a pack."""

import random

from pyspark.sql import functions as F

from vellum.operators import retrieval
from vellum.plans import retrieve


def test_rerank_in_packs(spark, monkeypatch):
    draw, words = random.Random(3), ["neuron", "neural", "net", "nets", "cs", "a", "EE", "cooking", "required", "été"]
    text = lambda: " ".join(draw.choices(words, k=draw.randint(0, 6)))
    chunks = spark.createDataFrame([(f"c{i}", text(), draw.choice(["CS", "EE", None]), draw.choice(["required", None])) for i in range(12)] + [("none", None, "CS", None)], "chunk_id string, text string, program string, requirement_type string")
    questions = spark.createDataFrame([(i, text() + draw.choice(["", " CS 101", " in CS"])) for i in range(15)] + [(99, None)], "question_id long, question string")
    found = questions.select("question_id").join(chunks.select("chunk_id"), F.xxhash64("question_id", "chunk_id") % 3 != 0).withColumn("rank", F.xxhash64("chunk_id"))
    found = found.union(spark.createDataFrame([(1000, "c1", 1)], found.schema))  # of no question
    monkeypatch.setattr(retrieve, "TURNS", 4)
    monkeypatch.setattr(retrieve, "PAIRS", 7)
    pairs = found.join(retrieve.named(questions), "question_id").join(chunks.withColumns({c: F.lit(None).cast(t) for c, t in retrieve.COLUMNS.items() if c not in chunks.columns}), "chunk_id")
    vectors = [retrieval.token_vectors(F.coalesce(c, F.lit(""))) for c in ("question", "text")]
    told = {}
    for r in pairs.select("question_id", "chunk_id", "rank", F.round(retrieval.late_interaction(*vectors), 6).alias("score"), retrieval.structured_scores().alias("metadata")).collect():
        told.setdefault(r.question_id, []).append((-round(r.score + 0.5 * r.metadata, 6), r["rank"], r.chunk_id, r.score))
    got = {}
    best = retrieve.rerank_many(chunks, questions, found, 3, 0.5)
    for r in best.collect():
        got.setdefault(r.question_id, {})[r["rank"]] = (r.chunk_id, r.rerank_score, -r.combined_rerank_score)
    assert got == {q: {i + 1: (c, s, b) for i, (b, _, c, s) in enumerate(sorted(x)[:3])} for q, x in told.items()}
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "MapInArrow" in plan
