"""Queries that build every kind of catalog card from records made of the driver's tables, with their SQL.

A record is a JSON line, as the catalog's files hold them; the builders of ``catalog`` make the cards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans import catalog
from vellum.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

P = "p_partkey AS k, p_name AS n, p_size AS s, p_brand AS b"
ALIASES = "'CS ' || k || ', CS' || k || ', cs ' || k || ', cs' || k"


def obj(**fields: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def records(spark: SparkSession, sf_dir: str, path: str, of: Callable[..., Column]) -> DataFrame:
    """source_path, line_no, line and v of one record a part, over all cores, as a record is many times its part; ``of`` gets key, name, size and brand."""
    made = of(F.col("p_partkey"), F.col("p_name"), F.col("p_size"), F.col("p_brand"))
    rows = spread(table(spark, sf_dir, "part")).select(F.lit(path).alias("source_path"), F.col("p_partkey").alias("line_no"), F.to_json(made).alias("line"))
    return rows.withColumn("v", F.parse_json("line"))


def card(kind: str, path: str, build: Callable[[DataFrame], list[DataFrame]], of: Callable[..., Column], lines: list[str], source: str, rows: str = f"(SELECT {P} FROM part)", line_no: str = "k", extra: str = "") -> None:
    """Registers the cards of a kind: record_line, source and the text's digest; ``lines`` are SQL texts, null where left out."""
    place = f"'Source data: {path}' || CASE WHEN {line_no} > 0 THEN ' line ' || {line_no} ELSE '' END || '.'"
    ORACLES[f"card_{kind}"] = f"SELECT CAST({line_no} AS BIGINT) AS record_line, {source} AS source, sha256(concat_ws(chr(10), {', '.join([*lines, place])})) AS digest FROM {rows} {extra}"

    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        cards = build(records(spark, sf_dir, path, of))
        found = next(x for x, name in zip(cards, KINDS[build]) if name == kind)
        return found.select("record_line", "source", F.sha2("text", 256).alias("digest"))

    QUERIES[f"card_{kind}"] = made


def programs(rows: DataFrame) -> list[DataFrame]:
    return catalog.requirement_cards(rows.withColumns({"program": F.lit("CS"), "program_type": F.lit("major"), "term_code": F.lit("202502")}))


#: The kinds of cards that each builder makes, in its order.
KINDS = {
    programs: ["program_requirement", "program_requirement_list"],
    catalog.course_cards: ["course_catalog_overview", "course_offering_history"],
    catalog.science_cards: ["basic_science_credit"],
    catalog.degree_cards: ["degree_requirement_profile", "degree_requirement_category_pool", "degree_requirement_pool_course", "official_degree_evaluation_summary", "official_degree_evaluation_category", "official_degree_evaluation_course_assignment", "degree_requirement_record"],
    catalog.graduation_cards: ["graduation_requirement_category", "graduation_requirement_summary", "graduation_requirement_course", "graduation_requirement_course_list"],
    catalog.term_cards: ["available_term", "available_terms_summary"],
    catalog.schedule_cards: ["schedule_section", "schedule_course_list"],
}

_KIND = "CASE s % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'area' ELSE b END"
_LABEL = "CASE s % 3 WHEN 0 THEN 'core elective / cekirdek secmeli' WHEN 1 THEN 'area elective / alan secmeli' ELSE b END"


def _kind(s: Column, b: Column) -> Column:
    return F.when(s % 3 == 0, "core").when(s % 3 == 1, "area").otherwise(b)


card(
    "program_requirement", "202502/CS.jsonl", programs,
    lambda k, n, s, b: obj(Major=F.lit("CS"), Code=k, Course_Name=n, EL_Type=_kind(s, b), SU_credit=s.cast("double"), ECTS=F.when(k % 2 == 0, s + 0.5), Faculty=F.lit("  FENS ")),
    ["'Record type: program curriculum requirement course eligibility.'", "'Program: CS (major).'", "'Term: 202502 - Spring 2025-2026 (Bahar).'", "'Course: CS ' || k || ' - ' || n || '.'", f"'Requirement category: ' || {_KIND} || ' (' || {_LABEL} || ').'",
     "'Interpretation: this course can count in this requirement category for the listed program and term.'", "'SU credit: ' || s || '.'", "CASE WHEN k % 2 = 0 THEN 'ECTS: ' || s || '.5.' END", "'Faculty: FENS.'", f"'Search aliases: ' || {ALIASES} || '.'"],
    f"'CS major 202502 ' || {_KIND} || ' CS ' || k",
)


def _page(k: Column, n: Column, s: Column, b: Column) -> Column:
    entry = lambda i: obj(term=F.concat(F.lit("T"), i), course_name=n, su_credit=s)
    terms = F.transform(F.filter(F.sequence(F.lit(0), (k % 70).cast("int")), lambda i: i > 0), entry)
    return obj(course_id=F.concat(F.lit("CS "), k), title=n, su_credits=s.cast("double"), prerequisites=F.when(k % 2 == 0, F.concat(F.lit("a\n "), b)), description=b, last_offered_terms=terms)


card(
    "course_catalog_overview", "all_coursepage_info.jsonl", catalog.course_cards, _page,
    ["'Record type: official course catalog overview.'", "'Course: CS ' || k || ' - ' || n || '.'", "'SU credits: ' || s || '.'", "CASE WHEN k % 2 = 0 THEN 'Prerequisites: a ' || b || '.' END", "'Description: ' || b",
     "CASE WHEN k % 70 > 0 THEN 'Recent offered terms: ' || array_to_string(list_transform(range(1, least(k % 70, 12) + 1), lambda i: 'T' || i || ' - ' || n || ' - SU credit ' || s), '; ') || CASE WHEN k % 70 > 12 THEN '; ; plus ' || (k % 70 - 12) || ' older entries' ELSE '' END || '.' END",
     f"'Search aliases: ' || {ALIASES} || '.'"],
    "'course catalog CS ' || k",
)

card(
    "course_offering_history", "all_coursepage_info.jsonl", catalog.course_cards, _page,
    ["'Record type: course offering history.'", "'Course: CS ' || k || ' - ' || n || '.'",
     "'Offering history part ' || part || ': ' || array_to_string(list_transform(range(30 * part - 29, least(k % 70, 30 * part) + 1), lambda i: 'T' || i || ' - ' || n || ' - SU credit ' || s), '; ') || '.'"],
    "'course offering history CS ' || k || ' part ' || part", f"(SELECT {P}, part FROM part, (VALUES (1), (2), (3)) AS v(part) WHERE p_partkey % 70 > 30 * (part - 1))",
)

card(
    "basic_science_credit", "basic_science_credits.jsonl", catalog.science_cards,
    lambda k, n, s, b: obj(subj_code=F.lit("CS"), crse_numb=k, ects=s, engineering=s / 2, breakdown_present=k % 2 == 0, scrape_ok=k % 3 == 0, scrape_error=F.when(k % 5 == 0, n)),
    ["'Record type: engineering and basic science credit breakdown.'", "'Course: CS ' || k || '.'", "'ECTS: ' || s || '.'", "'Engineering ECTS: ' || (s // 2) || CASE WHEN s % 2 = 1 THEN '.5' ELSE '' END || '.'",
     "'Breakdown present on source page: ' || CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END || '.'", "'Scrape OK: ' || CASE WHEN k % 3 = 0 THEN 'True' ELSE 'False' END || '.'", "CASE WHEN k % 5 = 0 THEN 'Scrape error: ' || n || '.' END",
     f"'Search aliases: ' || {ALIASES} || ', engineering credits, basic science credits.'"],
    "'credit breakdown CS ' || k",
)

_DEGREES = "degree_requirements/BSCS.jsonl"


def _profile(k: Column, n: Column, s: Column, b: Column) -> Column:
    minimum = F.array(obj(category=F.lit("core"), label_tr=F.when(k % 2 == 0, n), min_su_credits=s.cast("double"), min_courses=F.when(k % 3 == 0, s)))
    return obj(record_type=F.lit("degree_requirement_profile"), program=b, degree_code=F.when(k % 4 > 0, F.concat(F.lit("D"), k)), program_name_en=n, program_requirements_term=F.lit("202502"), total_min_su_credits=s, category_minima=minimum, rules=F.array(F.lit("r1"), F.lit(""), n), source_title=b)


_NAMED = "'Program: ' || b || ' / ' || CASE WHEN k % 4 > 0 THEN 'D' || k ELSE b END || ' - ' || n || '.'"
card(
    "degree_requirement_profile", _DEGREES, catalog.degree_cards, _profile,
    ["'Record type: official degree requirement profile.'", _NAMED, "'Program requirements term: 202502.'", "'Minimum total SU credits: ' || s || '.'",
     "'Category minima: ' || CASE WHEN k % 2 = 0 THEN n ELSE 'core' END || ' (min SU ' || s || CASE WHEN k % 3 = 0 THEN ', min courses ' || s ELSE '' END || ').'", "'Rules: r1; ' || n || '.'", "'Source title: ' || b || '.'"],
    "b || ' degree requirements profile ' || CASE WHEN k % 4 > 0 THEN 'D' || k ELSE b END",
)


def _pool(k: Column, n: Column, s: Column, b: Column) -> Column:
    course = obj(code=F.concat(F.lit("CS "), k), title_tr=n, su_credits=s.cast("double"), equivalent_to=F.when(k % 2 == 0, b))
    pools = F.array(obj(name=b, choose=F.lit(2), courses=F.array(obj(code=F.concat(F.lit("EE "), k), title_en=n))))
    return obj(record_type=F.lit("degree_requirement_category_pool"), program=b, degree_code=F.lit("D"), program_name_tr=n, category=F.when(k % 3 > 0, F.lit("Area Electives")), category_label_tr=n, min_su_credits=s, selection_rule=b, courses=F.array(course, obj(code=F.lit(None).cast("string"), title_tr=n, su_credits=F.lit(1.0), equivalent_to=b)), choice_pools=pools, source_title=b)


_CATEGORY = "CASE WHEN k % 3 > 0 THEN 'Area Electives' ELSE 'unknown' END"
_COURSE = "'CS ' || k || ' - ' || n || ' (SU ' || s || CASE WHEN k % 2 = 0 THEN ', equivalent to ' || b ELSE '' END || ')'"
card(
    "degree_requirement_category_pool", _DEGREES, catalog.degree_cards, _pool,
    ["'Record type: official degree requirement category pool.'", "'Program: ' || b || ' / D - ' || n || '.'", f"'Category: ' || {_CATEGORY} || ' - ' || n || '.'", "'Minimum SU credits: ' || s || '.'", "'Selection rule: ' || b || '.'",
     f"'Courses in this pool: ' || {_COURSE} || '.'", "'Choice pools: ' || b || ':' || chr(10) || 'choose 2' || chr(10) || 'courses EE ' || k || ' - ' || n || '.'", "'Source title: ' || b || '.'"],
    f"b || ' degree requirements ' || {_CATEGORY} || ' pool'",
)

card(
    "degree_requirement_pool_course", _DEGREES, catalog.degree_cards, _pool,
    ["'Record type: official degree requirement pool course.'", "'Program: ' || b || ' / D.'", f"'Category: ' || {_CATEGORY} || ' - ' || n || '.'", "'Course: ' || kind || ' ' || k || ' - ' || n || '.'",
     "CASE WHEN kind = 'CS' THEN 'SU credit: ' || s || '.' END", "CASE WHEN kind = 'CS' AND k % 2 = 0 THEN 'Equivalent to: ' || b || '.' END", "'Selection rule: ' || b || '.'"],
    f"b || ' degree requirements ' || {_CATEGORY} || ' ' || kind || ' ' || k", f"(SELECT {P}, kind FROM part, (VALUES ('CS'), ('EE')) AS v(kind))",
)


def _evaluation(k: Column, n: Column, s: Column, b: Column) -> Column:
    courses = F.array(obj(code=F.concat(F.lit("CS "), k), su_credits=s.cast("double")), obj(code=F.lit("MATH 101"), su_credits=F.lit(3.0)))
    categories = F.array(obj(category=F.lit("core"), label_tr=n, min_su_credits=s, completed_su_credits=s + 1, completed_ects=F.lit(5), course_count=F.lit(2), courses=courses), obj(category=F.lit(None).cast("string"), label_tr=b, min_su_credits=F.lit(None).cast("int"), completed_su_credits=s, completed_ects=F.lit(None).cast("int"), course_count=F.lit(None).cast("int"), courses=F.array().cast(courses_type)))
    return obj(record_type=F.lit("official_degree_evaluation_projection"), program=b, degree_code=F.lit("D"), program_name_tr=n, evaluation_term=F.lit("202501"), program_requirements_term=F.lit("202502"), result=F.when(k % 2 == 0, n), completed_total_su_credits=s, program_gpa=F.lit(3.5), categories=categories, source_title=b)


courses_type = "array<struct<code:string,su_credits:double>>"
_TAKEN = "'CS ' || k || ' (SU ' || s || '); MATH 101 (SU 3)'"
card(
    "official_degree_evaluation_summary", _DEGREES, catalog.degree_cards, _evaluation,
    ["'Record type: official degree evaluation projection.'", "'Program: ' || b || ' / D - ' || n || '.'", "'Evaluation term: 202501.'", "'Program requirements term: 202502.'", "CASE WHEN k % 2 = 0 THEN 'Result: ' || n || '.' END", "'Completed total SU credits: ' || s || '.'", "'Program GPA: 3.5.'",
     f"'Official category allocation summary: ' || n || ': ' || (s + 1) || '/' || s || ' SU; courses: ' || {_TAKEN} || ' | ' || b || ': ' || s || '/ SU; courses: .'", "'Source title: ' || b || '.'"],
    "b || ' official degree evaluation summary D'",
)

card(
    "official_degree_evaluation_category", _DEGREES, catalog.degree_cards, _evaluation,
    ["'Record type: official degree evaluation category allocation.'", "'Program: ' || b || ' / D.'", "'Category: ' || kind || ' - ' || CASE WHEN kind = 'core' THEN n ELSE b END || '.'", "CASE WHEN kind = 'core' THEN 'Minimum SU credits: ' || s || '.' END", "'Completed SU credits: ' || CASE WHEN kind = 'core' THEN s + 1 ELSE s END || '.'",
     "CASE WHEN kind = 'core' THEN 'Completed ECTS: 5.' END", "CASE WHEN kind = 'core' THEN 'Completed course count: 2.' END", f"'Courses officially allocated to this category: ' || CASE WHEN kind = 'core' THEN {_TAKEN} ELSE '' END || '.'", f"'{catalog.ALLOCATED}'"],
    "b || ' official degree evaluation ' || kind", f"(SELECT {P}, kind FROM part, (VALUES ('core'), ('unknown')) AS v(kind))",
)

card(
    "official_degree_evaluation_course_assignment", _DEGREES, catalog.degree_cards, _evaluation,
    ["'Record type: official degree evaluation course assignment.'", "'Program: ' || b || ' / D.'", "'Course: ' || course || '.'", "'Officially allocated category: core - ' || n || '.'", "'SU credit counted: ' || CASE WHEN course = 'MATH 101' THEN 3 ELSE s END || '.'", f"'{catalog.COUNTED}'"],
    "b || ' official degree evaluation core ' || course", f"(SELECT {P}, course FROM part, (VALUES ('MATH 101'), ('CS ' || p_partkey)) AS v(course))",
)

card(
    "degree_requirement_record", _DEGREES, catalog.degree_cards, lambda k, n, s, b: obj(record_type=F.lit("note"), program=b, key=k, name=n),
    ["'Record type: degree requirement source record.'", "'Program: ' || b || ' / ' || b || ' - .'", "'Record type field: note.'", """'Raw JSON: {"key": ' || k || ', "name": "' || n || '", "program": "' || b || '", "record_type": "note"}.'"""],
    "b || ' degree requirement record note'",
)


def _graduation(k: Column, n: Column, s: Column, b: Column) -> Column:
    detail = F.to_json(obj(min_su_kredi=s.cast("double"), min_ders_sayisi=F.when(k % 2 == 0, s), notlar=F.array(n, b)))
    summary = F.concat(F.lit('{"tip": "' + catalog.SUMMARY_MARK + '", "aciklama": "'), n, F.lit('", "toplam_min_su_kredi": 125, "kategoriler": {"Z": '), detail, F.lit(', "odd": 7, "A": {"min_akts": "10"}}}'))
    return F.when(k % 10 == 0, summary).otherwise(F.to_json(obj(kategori=F.when(k % 7 > 0, b), kod=F.when(k % 3 > 0, F.concat(F.lit("CS "), k)), ad=n, zorunluluk=F.lit("evet"), su_kredi=s.cast("double"))))


def _graduation_rows(rows: DataFrame) -> list[DataFrame]:
    """The records are texts already: ``to_json`` has wrapped them."""
    line = F.get_json_object("line", "$.x")
    return catalog.graduation_cards(rows.withColumns({"line": line, "v": F.parse_json(line)}))


KINDS[_graduation_rows] = KINDS[catalog.graduation_cards]
_GRADUATION = "graduation_requirements.jsonl"
_graduation_of = lambda k, n, s, b: obj(x=_graduation(k, n, s, b))
card(
    "graduation_requirement_category", _GRADUATION, _graduation_rows, _graduation_of,
    ["'Record type: graduation requirement category.'", "'Program description: ' || n || '.'", "'Category: ' || kind || '.'", "CASE WHEN kind = 'Z' THEN 'Minimum SU credits: ' || s || '.' END", "CASE WHEN kind = 'Z' AND k % 2 = 0 THEN 'Minimum course count: ' || s || '.' END", "CASE WHEN kind = 'A' THEN 'Minimum ECTS: 10.' END", "CASE WHEN kind = 'Z' THEN 'Notes: ' || n || '; ' || b || '.' END"],
    "'graduation requirement category ' || kind", f"(SELECT {P}, kind FROM part, (VALUES ('Z'), ('A')) AS v(kind) WHERE p_partkey % 10 = 0)",
)
card(
    "graduation_requirement_summary", _GRADUATION, _graduation_rows, _graduation_of,
    ["'Record type: graduation requirements summary.'", "'Description: ' || n || '.'", "'Minimum total SU credits: 125.'",
     "'Category Z:' || chr(10) || 'minimum SU credits: ' || s || '.' || chr(10) || CASE WHEN k % 2 = 0 THEN 'minimum course count: ' || s || '.' || chr(10) ELSE '' END || 'notes: ' || n || '; ' || b || chr(10) || 'Category A:' || chr(10) || 'minimum ECTS: 10.'"],
    "'graduation requirements summary'", extra="WHERE k % 10 = 0",
)
_RULE = "CASE WHEN k % 7 > 0 THEN b ELSE 'unknown' END"
_CODE = "CASE WHEN k % 3 > 0 THEN 'CS ' || k ELSE '' END"
card(
    "graduation_requirement_course", _GRADUATION, _graduation_rows, _graduation_of,
    ["'Record type: graduation requirement course rule.'", f"'Category: ' || {_RULE} || '.'", "'Requirement status: evet.'", "'Course: ' || CASE WHEN k % 3 > 0 THEN 'CS ' || k || ' - ' ELSE '' END || n || '.'", "'SU credit: ' || s || '.'"],
    f"'graduation requirement ' || {_RULE} || ' ' || {_CODE}", extra="WHERE k % 10 > 0",
)
card(
    "graduation_requirement_course_list", _GRADUATION, _graduation_rows, _graduation_of,
    ["'Record type: aggregate graduation requirement course list.'", "'Category: ' || kind || '.'", "'This card lists ' || count(*) || ' of ' || any_value(total) || ' course rules in this category.'", f"'Courses: ' || string_agg({_CODE} || ' - ' || n || ' (evet, SU ' || s || ')', '; ' ORDER BY k) || '.'"],
    "'graduation requirement ' || kind || ' list part ' || (part + 1)",
    f"(SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY k) - 1) // {catalog.COURSES_A_CARD} AS part, count(*) OVER (PARTITION BY kind) AS total FROM (SELECT *, {_RULE} AS kind FROM (SELECT {P} FROM part) WHERE k % 10 > 0))", line_no="0", extra="GROUP BY kind, part",
)

_SEASON = "CASE k % 3 WHEN 0 THEN 'Fall' WHEN 1 THEN 'Spring' ELSE 'Summer' END || ' ' || (2000 + k % 30) || '-' || (2001 + k % 30) || ' (' || CASE k % 3 WHEN 0 THEN 'Guz' WHEN 1 THEN 'Bahar' ELSE 'Yaz' END || ')'"
_TERM = "(2000 + k % 30) || '0' || (k % 3 + 1)"


def _term_code(k: Column) -> Column:
    return F.concat((F.lit(2000) + k % 30).cast("string"), F.lit("0"), (k % 3 + 1).cast("string"))


_term_of = lambda k, n, s, b: obj(term=_term_code(k), majors=F.array(n, b))
card(
    "available_term", "terms.jsonl", catalog.term_cards, _term_of,
    ["'Record type: available data term.'", f"'Term: ' || {_TERM} || ' - ' || {_SEASON} || '.'", "'Programs with data in this term: ' || n || ', ' || b || '.'"], f"'available term ' || {_TERM}",
)
card(
    "available_terms_summary", "terms.jsonl", catalog.term_cards, _term_of,
    ["'Record type: all available terms summary.'", f"'Available term codes and names: ' || string_agg({_TERM} || ' (' || {_SEASON} || ')', '; ' ORDER BY k) || '.'"], "'available terms summary'", line_no="0",
)

_section_of = lambda k, n, s, b: obj(course_id=F.concat(F.lit("cs"), k % 50), title=F.concat(F.lit("Course "), k % 50), crn=k, section=F.lit("A"), component=b, credits=s.cast("double"), subject=F.when(k % 2 == 0, F.lit("CS")), meetings=F.array(obj(days=F.lit("MW"), time=F.lit("9:40"), where=n), obj(days=F.lit("R"), time=F.lit(None).cast("string"), where=F.lit(None).cast("string"))))
_MEET = "'Monday/Wednesday, 9:40, at ' || n || ' | Thursday'"
card(
    "schedule_section", "schedule/202502.jsonl", catalog.schedule_cards, _section_of,
    ["'Record type: scheduled course section.'", "'Term: 202502 - Spring 2025-2026 (Bahar).'", "'Course: CS ' || c || ' - Course ' || c || '.'", "'CRN: ' || k || '.'", "'Section: A.'", "'Component: ' || b || '.'", "'Credits: ' || s || '.'", f"'Meetings: ' || {_MEET} || '.'", "CASE WHEN k % 2 = 0 THEN 'Subject: CS.' END",
     "'Search aliases: CS ' || c || ', CS' || c || ', cs ' || c || ', cs' || c || ', CRN ' || k || '.'"],
    "'schedule 202502 CS ' || c || ' section A CRN ' || k", f"(SELECT {P}, p_partkey % 50 AS c FROM part)",
)
card(
    "schedule_course_list", "schedule/202502.jsonl", catalog.schedule_cards, _section_of,
    ["'Record type: aggregate schedule for a course in a term.'", "'Term: 202502 - Spring 2025-2026 (Bahar).'", "'Course: CS ' || c || ' - Course ' || c || '.'", "'This card lists ' || count(*) || ' of ' || any_value(total) || ' scheduled sections for this course.'",
     f"'Sections: ' || string_agg('CRN ' || k || chr(10) || 'section A' || chr(10) || 'component ' || b || chr(10) || 'credits ' || s || chr(10) || {_MEET}, '; ' ORDER BY k) || '.'"],
    "'schedule 202502 CS ' || c || ' list part ' || (part + 1)",
    f"(SELECT *, (row_number() OVER (PARTITION BY c ORDER BY k) - 1) // {catalog.SECTIONS_A_CARD} AS part, count(*) OVER (PARTITION BY c) AS total FROM (SELECT {P}, p_partkey % 50 AS c FROM part))", line_no="0", extra="GROUP BY c, part",
)
