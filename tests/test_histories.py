"""Histories of offerings: each entry is parsed once, and records are made over all cores."""

import json

from pyspark.sql import functions as F

from vellum.plans import card_queries, catalog


def test_entries_are_parsed_once(spark):
    odd = ['{"term": 202501.0, "course_name": " a\\n b\\u2003", "su_credit": 3.0}', '"text"', "null", "[1]", '{"term": true, "su_credit": null}', '{"course_name": "x  y", "su_credit": "2 "}', "{}", '{"term": "a\\tb", "course_name": [1, "z"], "su_credit": 1}']
    lines = ['{"course_id": "CS 101", "title": "t", "last_offered_terms": [%s]}' % ", ".join(odd + ['{"term": "T%d"}' % i for i in range(60)]), '{"course_id": "CS 2", "last_offered_terms": []}', '{"course_id": "CS 3", "last_offered_terms": "no list"}', '{"course_id": "CS 4"}']
    rows = spark.createDataFrame([("p", i + 1, x) for i, x in enumerate(lines)], "source_path string, line_no long, line string").withColumn("v", F.parse_json("line"))
    history = catalog.course_cards(rows)[1]
    told = {r.part: r.text.split("\n")[2] for r in history.select("part", "text").collect()}
    first = ["202501 - a  b - SU credit 3.0", "True", "x y - SU credit 2 ", "", 'a b - [1,"z"] - SU credit 1']
    assert told[1] == "Offering history part 1: " + "; ".join(first + [f"T{i}" for i in range(22)]) + "."
    assert told[2] == "Offering history part 2: " + "; ".join(f"T{i}" for i in range(22, 52)) + "."
    assert told[3] == "Offering history part 3: " + "; ".join(f"T{i}" for i in range(52, 60)) + "." and len(told) == 3
    plan = history._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(lambda") == 1 and plan.count("from_json") == 1


def test_records_over_all_cores(spark, tmp_path):
    rows = [(i, f"part {i}", "B", 7) for i in range(100)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = card_queries.records(spark, str(tmp_path), "x.jsonl", lambda k, n, s, b: card_queries.obj(key=k, name=n))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted((r.line_no, json.loads(r.line)["name"]) for r in made.select("line_no", "line").collect()) == [(i, f"part {i}") for i in range(100)]
