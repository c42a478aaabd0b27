"""The course list, JSON records and paths of indexed folders."""

import json

from pyspark.sql import functions as F

from vellum.plans import courses
from vellum.plans.lifecycle import Store
from vellum.sources import documents as sources


def test_seeds_and_list(spark):
    rows = [
        {"course_id": "cs412", "title": " Machine\n Learning ", "su_credits": 3.0}, {"parsed_subj_code": "EE", "parsed_crse_numb": 200, "header_text": "Circuits", "ects": None}, {"course_id": "CS 412", "title": "Later", "engineering": 2.5},
        {"course_id": "X", "title": "no number"}, {"course_id": "NOTITLE 1"}, {"title": "no code"},
    ]
    lines = spark.createDataFrame([(i + 1, json.dumps(r)) for i, r in enumerate(rows)], "line_no int, line string").select("line_no", F.parse_json("line").alias("v"))
    found = courses.seeds(lines)
    got = {r.code: (r.subject, r.number, r.title, r.su_credits, r.engineering_ects) for r in found.collect()}
    assert got == {"CS 412": ("CS", "412", "Later", None, "2.5"), "EE 200": ("EE", "200", "Circuits", None, None), "X": ("X", "", "no number", None, None)}
    assert [r.code for r in courses.shown(found).collect()] == ["CS 412", "EE 200", "X"] and [r.code for r in courses.shown(found, " ciRc ").collect()] == ["EE 200"]
    assert [r.code for r in courses.shown(found, limit=1).collect()] == ["CS 412"] and courses.shown(found, "%").count() == 0


def test_json_records():
    assert sources.json_records('[1, {"é": [2]}]', 1) == [("items 1-1", "[\n  1\n]"), ("items 2-2", '[\n  {\n    "é": [\n      2\n    ]\n  }\n]')]
    assert sources.json_records('{"a": 1, "b": null}') == [("a", "1"), ("b", "null")] and sources.json_records("3") == [(None, "3")] and sources.json_records("[]") == []


def test_folders_tell_equal_names_apart(spark, tmp_path):
    for name in ("m1/a b.txt", "m2/a b.txt", "top.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(f"text of {name}")
    store = Store(spark, f"{tmp_path}/store")
    assert store.index_folder(f"{tmp_path}/in") == 3 and store.index_folder(f"{tmp_path}/in") == 0
    rows = store.read("chunks").collect()
    assert {(r.source, r.source_path, r.module) for r in rows} == {("m1/a b.txt", "m1/a b.txt", "m1"), ("m2/a b.txt", "m2/a b.txt", "m2"), ("top.txt", "top.txt", "sources")}
