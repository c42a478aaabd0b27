"""Line numbers over splits, vectors at ingestion, the cache of vectors, and stored intent models."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vellum.functions import embed
from vellum.operators import cells
from vellum.operators.cache import Vectors
from vellum.plans import intent, retrieve
from vellum.plans.lifecycle import Store
from vellum.sources.documents import json_lines


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    said = [("" if i % 7 == 3 else "   " if i % 11 == 5 else json.dumps({"i": i, "pad": "x" * (i % 90)})) for i in range(4000)]
    (tmp_path / "a.jsonl").write_bytes("\r\n".join(said).encode() + b"\n\n")
    (tmp_path / "b.jsonl").write_bytes(b'\n{"i": 1}')
    (tmp_path / "c.jsonl").write_bytes(b"")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        found = json_lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 20
        rows = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert rows == [("a.jsonl", i, line) for i, line in enumerate(said, 1) if line.strip()] + [("b.jsonl", 2, '{"i": 1}')]


def brute_counts(text):
    counts, word = [0] * embed.DIMENSIONS, ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            digest = hashlib.md5(word.encode()).hexdigest()
            for j in range(embed.SPREAD):
                v = int(digest[4 * j : 4 * j + 4], 16)
                counts[v % embed.DIMENSIONS] += -1 if v // embed.DIMENSIONS % 2 else 1
            word = ""
    return counts


def test_hashed_words(spark):
    texts = {"1": "The cat, the CAT and 7 cats.", "2": "größer Öl", "3": "x" * 5000 + " " + "y " * 900}
    rows = spark.createDataFrame([*texts.items(), ("none", None), ("empty", " - ")], "id string, text string")
    assert {r.id: r.counts for r in embed.counts(rows, "id").collect()} == {i: brute_counts(t) for i, t in texts.items()}
    for r in embed.vectors(rows, "id").collect():
        assert sum(x * x for x in r.vector) == pytest.approx(1)


def test_cached_vectors_are_computed_once(spark, tmp_path):
    held = Vectors(spark, f"{tmp_path}/v")
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, "")], "id long, text string")
    first = {r.id: r.embedding for r in held.add(rows).collect()}
    assert held.computed == 3 and first[1] == first[2] and first[4] is None
    assert {r.id: r.embedding for r in held.add(rows).collect()} == first and held.computed == 0
    held.add(rows.union(spark.createDataFrame([(6, "new")], rows.schema)))
    assert held.computed == 1


def test_an_ingested_chunk_is_found_densely(spark, tmp_path):
    held = Store(spark, f"{tmp_path}/store")
    for name, text in (("a", "Machine learning and neural networks for beginners"), ("b", "Cooking pasta with tomatoes"), ("c", "Rivers and lakes of the north")):
        assert held.ingest_text(text, name, "course", f"course:{name}") == 1
    assert held.vectors().table.read().count() == 3
    best = held.nearest("neural networks and machine learning", 2).orderBy("rank").collect()
    assert [r.source for r in best][0] == "a" and [r["rank"] for r in best] == [1, 2] and best[0].distance < best[1].distance
    assert held.nearest("...", 2).collect() == []


def test_stored_models_predict_as_fitted_ones(spark, tmp_path, monkeypatch):
    path, asked = f"{tmp_path}/model", spark.createDataFrame([("hangi dersleri almaliyim",), ("how many credits are left",), ("",)], "query string")
    fitted = intent.IntentModel.fit(intent.training_rows(spark))
    assert fitted.save(spark, path) == 1 and fitted.save(spark, path) == 2
    told = fitted.predict(asked).collect()
    monkeypatch.setattr(intent.IntentModel, "fit", lambda rows: pytest.fail("fitted again"))
    assert intent.IntentModel.load(spark, path, 1).predict(asked).collect() == told
    assert intent.detect(spark, path, asked).collect() == told
    monkeypatch.setattr(intent.IntentModel, "load", lambda *a: pytest.fail("loaded again"))
    assert intent.detect(spark, path, asked).collect() == told
    with pytest.raises(FileNotFoundError):
        monkeypatch.undo()
        intent.IntentModel.load(spark, f"{tmp_path}/none")


def test_many_questions_as_one_by_one(spark):
    rows = [(f"c{i:02}", f"text {i} about {'required' if i % 2 else 'core'} courses", [float(i % 7), float(i % 3)], ["CS 101", "EE 204", None][i % 3], ["required", "core"][i % 2], ["CS", "EE"][i % 4 // 2], ["exam", "course"][i % 2]) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, embedding array<double>, course_id string, requirement_type string, program string, documentType string")
    for route, asked in ((None, ["required CS 101 or EE 204", "what is this about", "CS 999 required"]), ("exam", ["core courses in EE", ""])):
        questions = spark.createDataFrame([(i, q, [1.0, 2.0], route) for i, q in enumerate(asked)], "question_id long, question string, vector array<double>, route string")
        many = {(r.question_id, r["rank"]): (r.chunk_id, r.score) for r in retrieve.retrieve_many(chunks, questions, 5).collect()}
        one = {}
        for i, q in enumerate(asked):
            for r in retrieve.retrieve(chunks, q, [1.0, 2.0], 5, {"documentType": route} if route else None).collect():
                one[i, r["rank"]] = (r.chunk_id, r.score)
        assert many == one
    assert cells.CENTRES


def test_reranked_by_late_interaction(spark):
    chunks = spark.createDataFrame([("a", "networks of neurons", "CS"), ("b", "cooking", None), ("c", None, "CS")], "chunk_id string, text string, program string")
    questions = spark.createDataFrame([(1, "neural network in CS"), (2, None)], "question_id long, question string")
    found = questions.select("question_id").join(chunks.select("chunk_id"), F.lit(True)).withColumn("rank", F.ascii("chunk_id"))
    best = retrieve.rerank_many(chunks, questions, found, 3).orderBy("question_id", "rank").collect()
    assert [r.chunk_id for r in best] == ["a", "c", "b", "a", "b", "c"]
    assert best[0].combined_rerank_score == pytest.approx(best[0].rerank_score + 6) and best[1].rerank_score == 0
