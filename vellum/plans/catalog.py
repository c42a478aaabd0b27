"""Catalog cards: a tree of JSON-lines files as one DataFrame of text cards with typed metadata.

Rows stay variants, as any field may be a number, a text, null or absent. One scan reads the tree; each
kind of card is a projection of it, and list cards are grouped windows.
"""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.text import maybe, say
from vellum.operators import cards
from vellum.sources.documents import json_lines

# Fixed values.
COURSES_A_CARD, SECTIONS_A_CARD, TERMS_A_CARD, RECENT_TERMS = 70, 20, 30, 12
SUMMARY_MARK = "MEZUNİYET_KOŞULLARI_ÖZETI"
LABELS = {
    "required": "required course / zorunlu ders", "core": "core elective / cekirdek secmeli", "area": "area elective / alan secmeli",
    "free": "free elective / serbest secmeli", "university": "university course / universite dersi", "unknown": "unknown requirement category",
}
ALLOCATED = "Interpretation: for this official Degree Evaluation, these completed courses count in this exact category; do not move them to another category unless a newer official evaluation source says so."
COUNTED = "Interpretation: this course is already counted in the listed category in the official Degree Evaluation projection."
REQUIREMENTS, EVALUATION = "official_degree_requirements", "official_degree_evaluation"

#: Metadata of cards; absent values are null.
METADATA = {
    **dict.fromkeys("program program_type term_code term_name requirement_type course_id course_subject course_number course_title faculty source_url degree_code program_name program_requirements_term evaluation_term source_authority category crn section component".split(), "string"),
    **dict.fromkeys("part course_count section_count term_count".split(), "long"), "aggregate": "boolean",
}


def at(v: Column | str, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def value(v: Column) -> Column:
    """Text of a variant: whole numbers without a fraction, booleans capitalised, white space normalised; null is empty, and lists are JSON."""
    kind, said = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    whole = F.regexp_replace(F.try_variant_get(v, "$", "decimal(38,0)").cast("string"), r"\.0+$", "")
    number = F.try_variant_get(v, "$", "double")
    return F.when(kind == "BOOLEAN", F.initcap(said)).when(kind.isin("DOUBLE", "FLOAT") & (number == F.floor(number)), whole).otherwise(T.normalize_text(F.coalesce(said, F.lit(""))))


def plain(v: Column) -> Column:
    """`value`, which leaves texts that are normal already to one look."""
    text = lambda said: F.when(said.rlike(r"[\r\n\t]|  |(?U)^\s|\s$"), T.normalize_text(said)).otherwise(said)
    return F.when(F.schema_of_variant(v) == "STRING", T.let(F.try_variant_get(v, "$", "string"), text)).otherwise(value(v))


def of(v: Column | str, *names: str) -> Column:
    """Text of the first field that isn't null or empty."""
    found = value(at(v, names[-1]))
    for name in reversed(names[:-1]):
        found = T.or_else(value(at(v, name)), found)
    return found


def given(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string").isNotNull()


def items(v: Column | str, name: str) -> Column:
    """A list field's objects; null unless it is a list."""
    return F.filter(F.try_variant_get(v, f"$.{name}", "array<variant>"), lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def joined(found: Column, separator: str) -> Column:
    """Non-empty texts joined; empty for null."""
    return F.coalesce(F.array_join(F.filter(found, lambda x: x != ""), separator), F.lit(""))


def some(template: str, text: Column) -> Column:
    return maybe(say(template, text), text != "")


def aliases(course: Column) -> Column:
    return F.array_join(T.course_aliases(course), ", ")


def course_entries(courses: Column) -> Column:
    """``code - title (SU n, equivalent to x)`` of courses with a code, joined by ``; ``."""

    def entry(c: Column) -> Column:
        details = joined(F.array(some("SU {}", of(c, "su_credits")), some("equivalent to {}", of(c, "equivalent_to"))), ", ")
        return F.when(of(c, "code") == "", "").otherwise(F.concat(joined(F.array(of(c, "code"), of(c, "title_tr", "title_en")), " - "), some(" ({})", details)))

    return joined(F.transform(courses, entry), "; ")


def choice_pools(pools: Column) -> Column:
    pool = lambda p: T.lines(some("{}:", of(p, "name")), some("choose {}", of(p, "choose")), some("courses {}", course_entries(items(p, "courses"))))
    return joined(F.transform(pools, pool), "; ")


def minima(found: Column) -> Column:
    bits = lambda m: joined(F.array(*[maybe(say(f"min {label} {{}}", of(m, name)), given(m, name)) for label, name in (("SU", "min_su_credits"), ("ECTS", "min_ects"), ("courses", "min_courses"))]), ", ")
    return F.coalesce(F.array_join(F.transform(found, lambda m: say("{} ({})", of(m, "label_tr", "category"), bits(m))), "; "), F.lit(""))


def evaluations(found: Column) -> Column:
    one = lambda c: say("{}: {}/{} SU; courses: {}", of(c, "label_tr", "category"), of(c, "completed_su_credits"), of(c, "min_su_credits"), course_entries(items(c, "courses")))
    return F.coalesce(F.array_join(F.transform(found, one), " | "), F.lit(""))


def texts(v: Column | str, name: str) -> Column:
    """A list's texts joined by ``; ``, or the text of another value."""
    listed = F.try_variant_get(v, f"$.{name}", "array<variant>")
    return F.when(listed.isNull(), of(v, name)).otherwise(joined(F.transform(listed, value), "; "))


def meetings(found: Column) -> Column:
    def one(m: Column) -> Column:
        return joined(F.array(T.readable_days(of(m, "days")), of(m, "time"), some("at {}", of(m, "where")), some("date range {}", of(m, "date_range")), some("instructor {}", of(m, "instructors"))), ", ")

    return joined(F.transform(found, one), " | ")


def recent_terms(v: Column | str) -> Column:
    """The first terms, and how many more there are."""
    listed = F.try_variant_get(v, "$.last_offered_terms", "array<variant>")
    shown = F.filter(F.slice(listed, 1, RECENT_TERMS), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    said = F.transform(shown, lambda x: joined(F.array(of(x, "term"), of(x, "course_name"), some("SU credit {}", of(x, "su_credit"))), " - "))
    more = F.when(F.size(listed) > RECENT_TERMS, F.array(say("; plus {} older entries", F.size(listed) - RECENT_TERMS))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.array_join(F.concat(said, more), "; "), F.lit(""))


def card(rows: DataFrame, kind: str, source: Column, parts: list[Column], order: list[Column], **metadata: Column) -> DataFrame:
    """Cards of ``rows`` (source_path, line_no, ...): a text of the non-empty parts, an id, and metadata. ``order`` ranks cards within their file."""
    if unknown := set(metadata) - set(METADATA):
        raise ValueError(f"unknown metadata {sorted(unknown)}")
    place = F.when(F.col("line_no") > 0, say("Source data: {} line {}.", "source_path", "line_no")).otherwise(say("Source data: {}.", "source_path"))
    made = rows.select(
        source.alias("source"), "source_path", F.lit(kind).alias("document_type"), F.lit("course").alias("documentType"), F.col("line_no").cast("long").alias("record_line"),
        T.lines(*parts, place).alias("text"), F.array(*[x.cast("string") for x in order]).alias("place"),
        *[metadata.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in METADATA.items()],
    )
    return made.withColumn("chunk_id", T.card_id(F.col("document_type"), F.col("source_path"), F.col("record_line"), F.col("source"), F.col("text")))


def _in(number: Column) -> Column:
    return F.lpad(number.cast("string"), 12, "0")


def _row(*sub: Column) -> list[Column]:
    return [F.lit("0"), _in(F.col("line_no")), *sub]


def _list(*keys: Column) -> list[Column]:
    return [F.lit("1"), *keys, _in(F.col("part"))]


def requirement_cards(rows: DataFrame) -> list[DataFrame]:
    """Cards of program files (program, program_type, term_code beside the row): a card a course, and lists a category."""
    v = "v"
    rows = rows.withColumns({"course_id": T.lines(of(v, "Major"), of(v, "Code"), separator=" "), "requirement_type": T.or_else(of(v, "EL_Type"), F.lit("unknown")), "title": of(v, "Course_Name"), "term_name": T.term_name(F.col("term_code"))})
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    head = [
        say("Program: {} ({}).", "program", "program_type"), maybe(say("Term: {} - {}.", "term_code", "term_name"), F.col("term_name") != ""),
        maybe(F.lit("Term: current or non-term-specific minor catalog."), F.col("term_code").isNull() & (F.col("program_type") == "minor")),
    ]
    category = say("Requirement category: {} ({}).", "requirement_type", F.coalesce(F.try_element_at(labels, F.col("requirement_type")), F.col("requirement_type")))
    name = say("{} {} {} {}", "program", "program_type", F.coalesce("term_code", F.lit("current")), "requirement_type")
    # A term code is absent as null, its name as an empty text.
    own = {c: F.col(c) for c in ("program", "program_type", "term_code", "requirement_type")} | {"term_name": F.coalesce("term_name", F.lit(""))}
    single = card(
        rows, "program_requirement", say("{} {}", name, "course_id"),
        [F.lit("Record type: program curriculum requirement course eligibility."), *head, say("Course: {} - {}.", "course_id", "title"), category,
         F.lit("Interpretation: this course can count in this requirement category for the listed program and term."),
         *[T.field(label, of(v, key)) for label, key in (("SU credit", "SU_credit"), ("ECTS", "ECTS"), ("Engineering ECTS", "Engineering"), ("Basic science ECTS", "Basic_Science"), ("Faculty", "Faculty"), ("Faculty course flag", "Faculty_Course"))],
         say("Search aliases: {}.", aliases(F.col("course_id")))],
        _row(), **own, course_id=F.col("course_id"), course_subject=of(v, "Major"), course_number=of(v, "Code"), course_title=F.col("title"), faculty=of(v, "Faculty"),
    )
    entry = say("{} - {} (SU {}, ECTS {})", "course_id", "title", of(v, "SU_credit"), of(v, "ECTS"))
    lists = cards.grouped(rows, ["source_path", "requirement_type"], ["course_id", "line_no"], entry, COURSES_A_CARD, "; ", ["program", "program_type", "term_code", "term_name"]).withColumn("line_no", F.lit(0))
    many = card(
        lists, "program_requirement_list", say("{} list part {}", name, "part"),
        [F.lit("Record type: aggregate course list for a program requirement category."), *head, category, say("This card lists {} of {} courses in this category.", "n_in_card", "n_entries"),
         say("Courses: {}.", "body"), say("Search aliases: {} {} courses, {} curriculum, {} electives.", "program", "requirement_type", "program", "program")],
        _list(F.col("requirement_type")), **own, aggregate=F.lit(True), part=F.col("part"), course_count=F.col("n_in_card"),
    )
    return [single, many]


def course_cards(rows: DataFrame) -> list[DataFrame]:
    """Cards of course pages: an overview, and the history of offerings by slices of terms."""
    v = "v"
    rows = rows.withColumns({"course_id": T.or_else(of(v, "course_id"), T.lines(of(v, "subj_code"), of(v, "crse_numb"), separator=" ")), "title": of(v, "title", "header_text")})
    course, title = F.col("course_id"), say("Course: {} - {}.", "course_id", "title")
    overview = card(
        rows, "course_catalog_overview", say("course catalog {}", course),
        [F.lit("Record type: official course catalog overview."), title,
         *[T.field(label, of(v, key)) for label, key in (("SU credits", "su_credits"), ("ECTS", "ects"), ("Engineering ECTS", "engineering"), ("Basic science ECTS", "basic_science"), ("Prerequisites", "prerequisites"), ("Corequisites", "corequisites"))],
         some("Description: {}", of(v, "description")), some("Recent offered terms: {}.", recent_terms(v)), T.field("Source URL", of(v, "source_url")), T.field("Scraped at", of(v, "scraped_at")),
         say("Search aliases: {}.", aliases(course))],
        _row(F.lit("0")), course_id=course, course_subject=T.or_else(of(v, "subj_code"), T.subject_of(course)), course_number=T.or_else(of(v, "crse_numb"), T.number_of(course)), course_title=F.col("title"), source_url=of(v, "source_url"),
    )
    terms = F.from_json("line", "last_offered_terms array<string>")["last_offered_terms"]  # raw JSON, as credits are shown as written

    def offered(x: Column) -> Column:
        credit = T.let(F.coalesce(F.get_json_object(x, "$.su_credit"), F.lit("")), lambda c: some("SU credit {}", c))
        said = lambda told: joined(F.array(T.let(at(told, "term"), plain), T.let(at(told, "course_name"), plain), credit), " - ")
        return T.let(F.try_parse_json(x), lambda told: F.when(F.schema_of_variant(told).startswith("OBJECT"), said(told)))

    # Entries are made once, below the generator: a filter on what a projection makes would make it again.
    histories = T.let(F.transform(terms, offered), lambda said: F.transform(T.slices(said, TERMS_A_CARD), lambda part: F.array_join(F.array_compact(part), "; ")))
    sliced = rows.select("source_path", "line_no", "course_id", "title", F.posexplode(histories).alias("i", "history")).where("history <> ''").withColumn("part", (F.col("i") + 1).cast("long"))
    history = card(
        sliced, "course_offering_history", say("course offering history {} part {}", course, "part"),
        [F.lit("Record type: course offering history."), title, say("Offering history part {}: {}.", "part", "history")],
        _row(F.lit("1"), _in(F.col("part"))), course_id=course, course_subject=T.subject_of(course), course_number=T.number_of(course), course_title=F.col("title"), part=F.col("part"),
    )
    return [overview, history]


def science_cards(rows: DataFrame) -> list[DataFrame]:
    """A card a course of its engineering and basic-science credits."""
    v = "v"
    rows = rows.withColumn("course_id", T.or_else(of(v, "course_id"), T.lines(of(v, "subj_code"), of(v, "crse_numb"), separator=" ")))
    course = F.col("course_id")
    fields = (("ECTS", "ects"), ("Engineering ECTS", "engineering"), ("Basic science ECTS", "basic_science"), ("Breakdown present on source page", "breakdown_present"), ("Scrape OK", "scrape_ok"), ("Scrape error", "scrape_error"), ("Source URL", "source_url"), ("Scraped at", "scraped_at"))
    made = card(
        rows, "basic_science_credit", say("credit breakdown {}", course),
        [F.lit("Record type: engineering and basic science credit breakdown."), say("Course: {}.", course), *[T.field(label, of(v, key)) for label, key in fields],
         say("Search aliases: {}, engineering credits, basic science credits.", aliases(course))],
        _row(), course_id=course, course_subject=T.or_else(of(v, "subj_code"), T.subject_of(course)), course_number=T.or_else(of(v, "crse_numb"), T.number_of(course)), source_url=of(v, "source_url"),
    )
    return [made]


def _sorted_json(c: Column) -> Column:
    @F.pandas_udf("string")
    def dump(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True))

    return dump(c)


def degree_cards(rows: DataFrame) -> list[DataFrame]:
    """Cards of degree requirements: profiles, pools and their courses, evaluations with categories and assignments, and other records raw."""
    v = "v"
    stem = F.regexp_extract("source_path", r"([^/]*)\.jsonl$", 1)
    rows = rows.withColumn("record_type", T.or_else(of(v, "record_type"), F.lit("degree_requirement_record"))).withColumn("program", T.or_else(of(v, "program"), stem))
    rows = rows.withColumns({"degree_code": T.or_else(of(v, "degree_code"), F.col("program")), "program_name": of(v, "program_name_tr", "program_name_en"), "source_title": T.or_else(of(v, "source_title"), stem)})
    named, short, titled = say("Program: {} / {} - {}.", "program", "degree_code", "program_name"), say("Program: {} / {}.", "program", "degree_code"), say("Source title: {}.", "source_title")
    own = {"program": F.col("program"), "degree_code": F.col("degree_code")}

    def only(kind: str) -> DataFrame:
        return rows.where(F.col("record_type") == kind)

    categories, rules = minima(items(v, "category_minima")), texts(v, "rules")
    profile = card(
        only("degree_requirement_profile"), "degree_requirement_profile", say("{} degree requirements profile {}", "program", "degree_code"),
        [F.lit("Record type: official degree requirement profile."), named, T.field("Program requirements term", of(v, "program_requirements_term_label", "program_requirements_term")),
         *[T.field(label, of(v, key)) for label, key in (("Minimum total SU credits", "total_min_su_credits"), ("Minimum total ECTS", "total_min_ects"), ("Minimum program GPA", "min_program_gpa"), ("Minimum cumulative GPA", "min_cumulative_gpa"))],
         some("Category minima: {}.", categories), some("Rules: {}.", rules), titled],
        _row(), **own, program_name=F.col("program_name"), program_requirements_term=of(v, "program_requirements_term"), source_authority=F.lit(REQUIREMENTS), aggregate=F.lit(True),
    )

    pools = only("degree_requirement_category_pool").withColumn("category", T.or_else(of(v, "category"), F.lit("unknown"))).withColumn("requirement_type", T.requirement_type(F.col("category")))
    listed = F.try_variant_get(v, "$.courses", "array<variant>")
    courses = F.when(F.size(listed) > 0, items(v, "courses")).otherwise(items(v, "courses_representative"))
    pools = pools.withColumns({"courses": courses, "label": of(v, "category_label_tr")})
    kind = own | {"category": F.col("category"), "requirement_type": F.col("requirement_type")}
    labelled = say("Category: {} - {}.", "category", "label")
    pool = card(
        pools, "degree_requirement_category_pool", say("{} degree requirements {} pool", "program", "category"),
        [F.lit("Record type: official degree requirement category pool."), named, labelled,
         *[T.field(label, of(v, key)) for label, key in (("Minimum SU credits", "min_su_credits"), ("Minimum course count", "min_courses"), ("Selection rule", "selection_rule"))],
         some("Courses in this pool: {}.", course_entries(F.col("courses"))), some("Choice pools: {}.", choice_pools(items(v, "choice_pools"))), T.field("Full pool note", of(v, "full_pool_note")), titled],
        _row(F.lit("0")), **kind, source_authority=F.lit(REQUIREMENTS), aggregate=F.lit(True),
    )
    none = F.array().cast("array<variant>")
    chosen = F.flatten(F.coalesce(F.transform(items(v, "choice_pools"), lambda p: F.coalesce(items(p, "courses"), none)), F.array().cast("array<array<variant>>")))
    each = pools.select("*", F.posexplode(F.concat(F.coalesce("courses", none), chosen)).alias("i", "course")).withColumn("course_id", of("course", "code")).where("course_id <> ''")
    parsed = {"course_id": F.col("course_id"), "course_subject": T.subject_of(F.col("course_id")), "course_number": T.number_of(F.col("course_id"))}
    pool_course = card(
        each, "degree_requirement_pool_course", say("{} degree requirements {} {}", "program", "category", "course_id"),
        [F.lit("Record type: official degree requirement pool course."), short, labelled, say("Course: {} - {}.", "course_id", of("course", "title_tr", "title_en")),
         T.field("SU credit", of("course", "su_credits")), T.field("Equivalent to", of("course", "equivalent_to")), T.field("Selection rule", of(v, "selection_rule"))],
        _row(F.lit("1"), _in(F.col("i"))), **kind, **parsed, source_authority=F.lit(REQUIREMENTS),
    )

    graded = only("official_degree_evaluation_projection")
    fields = (("Program requirements term", "program_requirements_term"), ("Source authority", "source_authority"), ("Applies to", "applies_to"), ("Result", "result"), ("Completed total SU credits", "completed_total_su_credits"), ("Completed total ECTS", "completed_total_ects"), ("Program GPA", "program_gpa"), ("Cumulative GPA", "cumulative_gpa"))
    summary = card(
        graded, "official_degree_evaluation_summary", say("{} official degree evaluation summary {}", "program", "degree_code"),
        [F.lit("Record type: official degree evaluation projection."), named, T.field("Evaluation term", of(v, "evaluation_term_label", "evaluation_term")), *[T.field(label, of(v, key)) for label, key in fields],
         some("Official category allocation summary: {}.", evaluations(items(v, "categories"))), titled],
        _row(F.lit("0")), **own, program_requirements_term=of(v, "program_requirements_term"), evaluation_term=of(v, "evaluation_term"), source_authority=F.lit(EVALUATION), aggregate=F.lit(True),
    )
    entries = graded.select("*", F.posexplode(items(v, "categories")).alias("i", "entry")).withColumn("category", T.or_else(of("entry", "category"), F.lit("unknown")))
    entries = entries.withColumns({"requirement_type": T.requirement_type(F.col("category")), "label": of("entry", "label_tr")})
    category = card(
        entries, "official_degree_evaluation_category", say("{} official degree evaluation {}", "program", "category"),
        [F.lit("Record type: official degree evaluation category allocation."), short, labelled,
         *[T.field(label, of("entry", key)) for label, key in (("Minimum SU credits", "min_su_credits"), ("Completed SU credits", "completed_su_credits"), ("Completed ECTS", "completed_ects"), ("Completed course count", "course_count"))],
         say("Courses officially allocated to this category: {}.", course_entries(items("entry", "courses"))), F.lit(ALLOCATED)],
        _row(F.lit("1"), _in(F.col("i")), F.lit("0")), **kind, source_authority=F.lit(EVALUATION), aggregate=F.lit(True),
    )
    assigned = entries.select("*", F.posexplode(items("entry", "courses")).alias("j", "course")).withColumn("course_id", of("course", "code")).where("course_id <> ''")
    assignment = card(
        assigned, "official_degree_evaluation_course_assignment", say("{} official degree evaluation {} {}", "program", "category", "course_id"),
        [F.lit("Record type: official degree evaluation course assignment."), short, say("Course: {}.", "course_id"), say("Officially allocated category: {} - {}.", "category", "label"),
         T.field("SU credit counted", of("course", "su_credits")), F.lit(COUNTED)],
        _row(F.lit("1"), _in(F.col("i")), F.lit("1"), _in(F.col("j"))), **kind, **parsed, source_authority=F.lit(EVALUATION),
    )
    known = ("degree_requirement_profile", "degree_requirement_category_pool", "official_degree_evaluation_projection")
    other = card(
        rows.where(~F.col("record_type").isin(*known)), "degree_requirement_record", say("{} degree requirement record {}", "program", "record_type"),
        [F.lit("Record type: degree requirement source record."), named, say("Record type field: {}.", "record_type"), say("Raw JSON: {}.", _sorted_json(F.col("line")))],
        _row(), **own, source_authority=F.lit(REQUIREMENTS),
    )
    return [profile, pool, pool_course, summary, category, assignment, other]


def graduation_cards(rows: DataFrame) -> list[DataFrame]:
    """Cards of graduation requirements: the summary row's categories in the row's order, a card a course rule, and lists a category."""
    v = "v"
    is_summary = F.coalesce(F.try_variant_get(v, "$.tip", "string") == SUMMARY_MARK, F.lit(False))
    told = F.transform(F.map_entries(F.from_json("line", "kategoriler map<string,string>")["kategoriler"]), lambda e: F.struct(e["key"].alias("name"), F.try_parse_json(e["value"]).alias("details")))
    kept = F.filter(told, lambda e: F.coalesce(F.schema_of_variant(e["details"]).startswith("OBJECT"), F.lit(False)))
    rules = rows.where(is_summary).withColumn("categories", kept)
    notes = lambda d: F.coalesce(F.array_join(F.try_variant_get(d, "$.notlar", "array<string>"), "; "), F.lit(""))
    fields = lambda d, labels: [T.field(label, of(d, key)) for label, key in zip(labels, ("min_su_kredi", "min_ders_sayisi", "min_akts"))]
    block = lambda e: T.lines(say("Category {}:", e["name"]), *fields(e["details"], ("minimum SU credits", "minimum course count", "minimum ECTS")), some("notes: {}", notes(e["details"])))
    each = rules.select("*", F.posexplode("categories").alias("i", "entry"))
    category = card(
        each, "graduation_requirement_category", say("graduation requirement category {}", "entry.name"),
        [F.lit("Record type: graduation requirement category."), T.field("Program description", of(v, "aciklama")), say("Category: {}.", "entry.name"),
         *fields(F.col("entry.details"), ("Minimum SU credits", "Minimum course count", "Minimum ECTS")), some("Notes: {}.", notes(F.col("entry.details")))],
        _row(F.lit("0"), _in(F.col("i"))), category=F.col("entry.name"),
    )
    summary = card(
        rules, "graduation_requirement_summary", F.lit("graduation requirements summary"),
        [F.lit("Record type: graduation requirements summary."), T.field("Description", of(v, "aciklama")), T.field("Minimum total SU credits", of(v, "toplam_min_su_kredi")), F.coalesce(F.array_join(F.transform("categories", block), "\n"), F.lit(""))],
        _row(F.lit("1")), program=F.lit("BSCS"),
    )
    courses = rows.where(~is_summary).withColumns({"category": T.or_else(of(v, "kategori"), F.lit("unknown")), "course_id": of(v, "kod"), "title": of(v, "ad")})
    single = card(
        courses, "graduation_requirement_course", say("graduation requirement {} {}", "category", "course_id"),
        [F.lit("Record type: graduation requirement course rule."), say("Category: {}.", "category"), T.field("Requirement status", of(v, "zorunluluk")),
         T.field("Course", F.when(F.col("course_id") != "", say("{} - {}", "course_id", "title")).otherwise(F.col("title"))),
         *[T.field(label, of(v, key)) for label, key in (("SU credit", "su_kredi"), ("Faculty", "fakulte"), ("Note", "not"))]],
        _row(), category=F.col("category"), course_id=F.col("course_id"), program=F.lit("BSCS"),
    )
    entry = say("{} - {} ({}, SU {})", "course_id", "title", of(v, "zorunluluk"), of(v, "su_kredi"))
    lists = cards.grouped(courses, ["source_path", "category"], ["line_no"], entry, COURSES_A_CARD, "; ").withColumn("line_no", F.lit(0))
    many = card(
        lists, "graduation_requirement_course_list", say("graduation requirement {} list part {}", "category", "part"),
        [F.lit("Record type: aggregate graduation requirement course list."), say("Category: {}.", "category"), say("This card lists {} of {} course rules in this category.", "n_in_card", "n_entries"), say("Courses: {}.", "body")],
        _list(F.col("category")), category=F.col("category"), program=F.lit("BSCS"), aggregate=F.lit(True), part=F.col("part"),
    )
    return [category, summary, single, many]


def term_cards(rows: DataFrame) -> list[DataFrame]:
    """A card a term, and one a file of all its terms."""
    v = "v"
    rows = rows.withColumn("term_code", of(v, "term")).withColumn("term_name", T.term_name(F.col("term_code")))
    listed = F.try_variant_get(v, "$.majors", "array<string>")
    single = card(
        rows, "available_term", say("available term {}", "term_code"),
        [F.lit("Record type: available data term."), say("Term: {} - {}.", "term_code", "term_name"), say("Programs with data in this term: {}.", F.coalesce(F.array_join(listed, ", "), F.try_variant_get(v, "$.majors", "string")))],
        _row(), term_code=F.col("term_code"), term_name=F.col("term_name"),
    )
    entry = say("{} ({})", "term_code", "term_name")
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", entry.alias("entry")))), lambda x: x["entry"]), "; ")
    files = rows.groupBy("source_path").agg(every.alias("body"), F.count(F.lit(1)).alias("n")).withColumn("line_no", F.lit(0))
    summary = card(
        files, "available_terms_summary", F.lit("available terms summary"), [F.lit("Record type: all available terms summary."), say("Available term codes and names: {}.", "body")],
        [F.lit("1")], aggregate=F.lit(True), term_count=F.col("n"),
    )
    return [single, summary]


def schedule_cards(rows: DataFrame) -> list[DataFrame]:
    """A card a section, and lists of a course's sections in a term."""
    v = "v"
    stem = F.regexp_extract("source_path", r"([^/]*)\.jsonl$", 1)
    rows = rows.withColumns({"term_code": T.or_else(of(v, "term"), stem), "course_id": T.spaced_course_id(of(v, "course_id")), "title": of(v, "title"), "crn": of(v, "crn"), "section": of(v, "section"), "component": of(v, "component"), "meetings": meetings(items(v, "meetings"))})
    rows = rows.withColumn("term_name", T.term_name(F.col("term_code")))
    term, course = say("Term: {} - {}.", "term_code", "term_name"), F.col("course_id")
    own = {"term_code": F.col("term_code"), "term_name": F.col("term_name"), "course_id": course, "course_title": F.col("title")}
    single = card(
        rows, "schedule_section", say("schedule {} {} section {} CRN {}", "term_code", "course_id", "section", "crn"),
        [F.lit("Record type: scheduled course section."), term, say("Course: {} - {}.", "course_id", "title"), T.field("CRN", F.col("crn")), T.field("Section", F.col("section")), T.field("Component", F.col("component")),
         T.field("Credits", of(v, "credits")), some("Meetings: {}.", F.col("meetings")), T.field("Subject", of(v, "subject")), T.field("Source URL", of(v, "source_url")), say("Search aliases: {}, CRN {}.", aliases(course), "crn")],
        _row(), **own, course_subject=T.or_else(of(v, "subject"), T.subject_of(course)), crn=F.col("crn"), section=F.col("section"), component=F.col("component"), source_url=of(v, "source_url"),
    )
    entry = T.lines(say("CRN {}", "crn"), say("section {}", "section"), say("component {}", "component"), say("credits {}", of(v, "credits")), F.col("meetings"))
    lists = cards.grouped(rows, ["source_path", "term_code", "course_id"], ["line_no"], entry, SECTIONS_A_CARD, "; ", ["title", "term_name"]).withColumn("line_no", F.lit(0))
    many = card(
        lists, "schedule_course_list", say("schedule {} {} list part {}", "term_code", "course_id", "part"),
        [F.lit("Record type: aggregate schedule for a course in a term."), term, say("Course: {} - {}.", "course_id", "title"), say("This card lists {} of {} scheduled sections for this course.", "n_in_card", "n_entries"), say("Sections: {}.", "body")],
        _list(F.col("term_code"), course), **own, aggregate=F.lit(True), part=F.col("part"), section_count=F.col("n_in_card"),
    )
    return [single, many]


#: Families of files by their path below the root, in the catalog's order: pattern, builder.
FAMILIES = (
    (r"^all_coursepage_info\.jsonl$", course_cards), (r"^basic_science_credits\.jsonl$", science_cards), (r"^graduation_requirements\.jsonl$", graduation_cards), (r"^terms\.jsonl$", term_cards),
    (r"^degree_requirements/[^/]+\.jsonl$", degree_cards), (r"^\d{6}/[^/]+\.jsonl$", requirement_cards), (r"^minors/[^/]+\.jsonl$", requirement_cards), (r"^minors/\d{6}/[^/]+\.jsonl$", requirement_cards),
    (r"^schedule/[^/]+\.jsonl$", schedule_cards),
)


def lines_of(spark: SparkSession, root: str) -> DataFrame:
    """source_path (below the root), line_no, line and v (its variant) of all JSON-lines files; a missing root or malformed JSON fails."""
    found = json_lines(spark, root, recursiveFileLookup="true", pathGlobFilter="*.jsonl")
    below = re.sub(r"^[A-Za-z0-9+.-]+://[^/]*", "", root).strip("/")
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    return found.select(F.regexp_replace(path, f"^.*?/{re.escape(below)}/+", "").alias("source_path"), "line_no", "line", F.parse_json("line").alias("v"))


def build(lines: DataFrame) -> DataFrame:
    """All cards of ``lines_of``, a union of the kinds, with family (order of the files' kinds) and place (order within a file)."""
    made = []
    for number, (pattern, builder) in enumerate(FAMILIES):
        rows = lines.where(F.col("source_path").rlike(pattern))
        if builder is requirement_cards:
            code = F.nullif(F.regexp_extract("source_path", r"^(?:minors/)?(\d{6})/", 1), F.lit(""))
            kind = F.when(F.col("source_path").startswith("minors/"), "minor").otherwise("major")
            rows = rows.withColumns({"program": F.regexp_extract("source_path", r"([^/]*)\.jsonl$", 1), "program_type": kind, "term_code": code})
        made += [x.withColumn("family", F.lit(number)) for x in builder(rows)]
    return functools.reduce(DataFrame.unionByName, made)


#: Order of cards in the catalog.
ORDER = ["family", "source_path", "place"]


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """All cards of the catalog tree below ``root``."""
    return build(lines_of(spark, root))


def rekeyed(made: DataFrame) -> DataFrame:
    """Cards as chunks of one source a file: sourceId by the file's path, chunkIndex in the file's order. Of cards with one id in a file, the first stays."""
    from pyspark.sql import Window

    from vellum.operators.store import first_per_key

    single = first_per_key(made, ["source_path", "chunk_id"], ["place"])
    source = T.source_id(F.lit("course"), T.content_hash(F.col("source_path")))
    index = (F.row_number().over(Window.partitionBy("source_path").orderBy("place")) - 1).cast("long")
    done = single.withColumns({"sourceId": source, "contentHash": T.content_hash(F.col("text")), "chunkIndex": index})
    return done.withColumn("chunk_id", T.chunk_id(F.col("sourceId"), F.col("chunkIndex"), F.col("text")))
