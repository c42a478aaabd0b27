"""Catalog cards of a small tree with numbers as texts, nulls, lists cut into parts, and entries to skip."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.plans import catalog

TREE = {
    "all_coursepage_info.jsonl": [
        {"course_id": "CS 412", "subj_code": "CS", "crse_numb": "412", "title": "Machine\n Learning", "su_credits": 3.0, "ects": "6", "engineering": 2.5, "prerequisites": None, "description": " d\t\te ",
         "last_offered_terms": [{"term": "Fall", "course_name": "ML", "su_credit": 3.0}] * 11 + ["odd"] + [{"term": "Old"}] * 19},
        {"subj_code": "EE", "crse_numb": 200, "header_text": "Circuits", "last_offered_terms": [None] * 30 + [{"term": "T31"}]},
    ],
    "basic_science_credits.jsonl": [{"course_id": "CS 412", "ects": 6, "breakdown_present": True, "scrape_ok": False, "scrape_error": None}],
    "graduation_requirements.jsonl": [
        {"tip": "MEZUNİYET_KOŞULLARI_ÖZETI", "aciklama": "Prog", "toplam_min_su_kredi": 125, "kategoriler": {"Z": {"min_su_kredi": 41.0, "notlar": ["a", "b"]}, "odd": 7, "A": {"min_akts": "10"}}},
        *[{"kategori": "core", "kod": f"CS {i}", "ad": f"n{i}", "zorunluluk": "evet", "su_kredi": 3} for i in range(71)],
        {"ad": "any", "not": "x"},
    ],
    "terms.jsonl": [{"term": "202502", "majors": ["CS", "EE"]}, {"term": 202509, "majors": "all"}],
    "degree_requirements/BSCS.jsonl": [
        {"record_type": "degree_requirement_profile", "program_name_en": "Comp", "total_min_su_credits": 125, "category_minima": [{"category": "core", "min_su_credits": 9, "min_courses": 3}, 5, {"label_tr": "x"}], "rules": ["r1", "", "r2"]},
        {"record_type": "degree_requirement_category_pool", "category": "Core Electives", "courses": [{"code": "CS 1", "title_tr": "bir", "su_credits": 3.0}, {"title_tr": "no code"}], "choice_pools": [{"name": "P", "choose": 2, "courses": [{"code": "CS 1", "title_tr": "bir", "su_credits": 3.0}]}]},
        {"record_type": "official_degree_evaluation_projection", "program": "CS", "result": "ok", "categories": [{"category": "area", "min_su_credits": 9, "completed_su_credits": 6, "courses": [{"code": "CS 2", "su_credits": 3}]}]},
        {"record_type": "note", "b": 1, "a": "ş"},
    ],
    "202502/CS.jsonl": [{"Major": "CS", "Code": f"{500 - i}", "Course_Name": "c", "EL_Type": "core", "SU_credit": 3.0, "ECTS": 6} for i in range(72)] + [{"Major": "MATH", "Code": 101}],
    "minors/MATH.jsonl": [{"Major": "MATH", "Code": "101", "Course_Name": "Calc", "EL_Type": "required"}],
    "schedule/202502.jsonl": [{"course_id": "cs412", "title": f"t{i}", "crn": 100 + i, "section": "A", "meetings": [{"days": "mW", "time": "9:40", "where": "L1"}, 3, {}]} for i in range(21)],
}


@pytest.fixture(scope="module")
def cards(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cat alog")
    for name, rows in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("\n\n".join(json.dumps(x, ensure_ascii=False) for x in rows) + "\n", encoding="utf-8")
    (root / "other.jsonl").write_text("{}")
    made = catalog.catalog(spark, str(root)).orderBy(*catalog.ORDER).collect()
    return made


def of(cards, kind, i=0):
    return [c for c in cards if c.document_type == kind][i]


def test_kinds(cards):
    n = {}
    for c in cards:
        n[c.document_type] = n.get(c.document_type, 0) + 1
    assert n == {
        "course_catalog_overview": 2, "course_offering_history": 3, "basic_science_credit": 1, "graduation_requirement_category": 2, "graduation_requirement_summary": 1, "graduation_requirement_course": 72,
        "graduation_requirement_course_list": 3, "available_term": 2, "available_terms_summary": 1, "degree_requirement_profile": 1, "degree_requirement_category_pool": 1, "degree_requirement_pool_course": 2,
        "official_degree_evaluation_summary": 1, "official_degree_evaluation_category": 1, "official_degree_evaluation_course_assignment": 1, "degree_requirement_record": 1, "program_requirement": 74,
        "program_requirement_list": 4, "schedule_section": 21, "schedule_course_list": 2,
    }


def test_course_texts(cards):
    c = of(cards, "course_catalog_overview")
    recent = "; ".join(["Fall - ML - SU credit 3"] * 11) + "; ; plus 19 older entries"
    assert c.text == (
        "Record type: official course catalog overview.\nCourse: CS 412 - Machine  Learning.\nSU credits: 3.\nECTS: 6.\nEngineering ECTS: 2.5.\nDescription: d e\n"
        f"Recent offered terms: {recent}.\nSearch aliases: CS 412, CS412, cs 412, cs412.\nSource data: all_coursepage_info.jsonl line 1."
    )
    assert (c.source, c.record_line, c.course_subject, c.course_number, c.source_url) == ("course catalog CS 412", 1, "CS", "412", "")
    first, second = of(cards, "course_offering_history"), of(cards, "course_offering_history", 1)
    assert first.text.split("\n")[2] == "Offering history part 1: " + "; ".join(["Fall - ML - SU credit 3.0"] * 11 + ["Old"] * 18) + "."
    assert second.text.split("\n")[2] == "Offering history part 2: Old."
    late = of(cards, "course_offering_history", 2)
    assert (late.part, late.text.split("\n")[2], late.record_line) == (2, "Offering history part 2: T31.", 3)
    assert "Breakdown present on source page: True.\nScrape OK: False.\nSearch" in of(cards, "basic_science_credit").text


def test_graduation_texts(cards):
    assert of(cards, "graduation_requirement_summary").text == (
        "Record type: graduation requirements summary.\nDescription: Prog.\nMinimum total SU credits: 125.\nCategory Z:\nminimum SU credits: 41.\nnotes: a; b\nCategory A:\nminimum ECTS: 10.\n"
        "Source data: graduation_requirements.jsonl line 1."
    )
    assert of(cards, "graduation_requirement_category").text.endswith("Category: Z.\nMinimum SU credits: 41.\nNotes: a; b.\nSource data: graduation_requirements.jsonl line 1.")
    lists = [c for c in cards if c.document_type == "graduation_requirement_course_list"]
    assert [(c.category, c.part, c.record_line) for c in lists] == [("core", 1, 0), ("core", 2, 0), ("unknown", 1, 0)]
    assert lists[1].text == "Record type: aggregate graduation requirement course list.\nCategory: core.\nThis card lists 1 of 71 course rules in this category.\nCourses: CS 70 - n70 (evet, SU 3).\nSource data: graduation_requirements.jsonl."
    assert "Course: any.\nNote: x." in of(cards, "graduation_requirement_course", -1).text
    assert of(cards, "available_terms_summary").text.split("\n")[1] == "Available term codes and names: 202502 (Spring 2025-2026 (Bahar)); 202509 (Unknown 2025-2026 (Unknown))."
    assert "Programs with data in this term: CS, EE." in of(cards, "available_term").text


def test_degree_texts(cards):
    assert of(cards, "degree_requirement_profile").text == (
        "Record type: official degree requirement profile.\nProgram: BSCS / BSCS - Comp.\nMinimum total SU credits: 125.\nCategory minima: core (min SU 9, min courses 3); x ().\nRules: r1; r2.\n"
        "Source title: BSCS.\nSource data: degree_requirements/BSCS.jsonl line 1."
    )
    pool = of(cards, "degree_requirement_category_pool")
    assert "Courses in this pool: CS 1 - bir (SU 3).\nChoice pools: P:\nchoose 2\ncourses CS 1 - bir (SU 3).\n" in pool.text and pool.requirement_type == "core" and pool.aggregate
    twice = [c for c in cards if c.document_type == "degree_requirement_pool_course"]
    assert twice[0].chunk_id == twice[1].chunk_id and twice[0].text.endswith("Course: CS 1 - bir.\nSU credit: 3.\nSource data: degree_requirements/BSCS.jsonl line 3.")
    assert "Official category allocation summary: area: 6/9 SU; courses: CS 2 (SU 3).\n" in of(cards, "official_degree_evaluation_summary").text
    assert of(cards, "official_degree_evaluation_course_assignment").source == "CS official degree evaluation area CS 2"
    assert 'Raw JSON: {"a": "ş", "b": 1, "record_type": "note"}.' in of(cards, "degree_requirement_record").text


def test_program_and_schedule_texts(cards):
    lists = [c for c in cards if c.document_type == "program_requirement_list"]
    assert [(c.program, c.requirement_type, c.part, c.course_count) for c in lists] == [("CS", "core", 1, 70), ("CS", "core", 2, 2), ("CS", "unknown", 1, 1), ("MATH", "required", 1, 1)]
    assert lists[1].text == (
        "Record type: aggregate course list for a program requirement category.\nProgram: CS (major).\nTerm: 202502 - Spring 2025-2026 (Bahar).\nRequirement category: core (core elective / cekirdek secmeli).\n"
        "This card lists 2 of 72 courses in this category.\nCourses: CS 499 - c (SU 3, ECTS 6); CS 500 - c (SU 3, ECTS 6).\nSearch aliases: CS core courses, CS curriculum, CS electives.\nSource data: 202502/CS.jsonl."
    )
    minor = of(cards, "program_requirement", -1)
    assert minor.source == "MATH minor current required MATH 101" and minor.term_code is None and "\nTerm: current or non-term-specific minor catalog.\n" in minor.text
    section = of(cards, "schedule_section")
    assert "Course: CS 412 - t0.\nCRN: 100.\nSection: A.\nMeetings: Monday/Wednesday, 9:40, at L1.\nSearch aliases: CS 412, CS412, cs 412, cs412, CRN 100." in section.text and section.program is None
    last = of(cards, "schedule_course_list", 1)
    assert (last.part, last.section_count, last.course_title) == (2, 1, "t20") and "Sections: CRN 120\nsection A\ncomponent\ncredits\nMonday/Wednesday, 9:40, at L1.\n" in last.text


def test_order_and_keys(spark, cards):
    kinds = [c.document_type for c in cards]
    assert kinds[:5] == ["course_catalog_overview", "course_offering_history", "course_offering_history", "course_catalog_overview", "course_offering_history"] and kinds[-1] == "schedule_course_list"
    rows = spark.createDataFrame([(c.source_path, c.chunk_id, c.text, list(c.place)) for c in cards], "source_path string, chunk_id string, text string, place array<string>")
    keyed = catalog.rekeyed(rows)
    assert keyed.count() == len(cards) - 1 and keyed.select("chunk_id").distinct().count() == len(cards) - 1
    assert keyed.groupBy("source_path").agg((F.max("chunkIndex") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0


def test_malformed_and_missing(spark, tmp_path):
    (tmp_path / "terms.jsonl").write_text("{oops")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        catalog.catalog(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        catalog.catalog(spark, str(tmp_path / "none"))
