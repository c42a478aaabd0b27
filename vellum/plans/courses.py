"""The course list: seeded from course pages, searched, and shown with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import store
from vellum.plans.catalog import given

TEXTS = ("code", "subject", "number", "title", "description", "prerequisites", "corequisites", "source_url")
CREDITS = ("su_credits", "ects", "engineering_ects", "basic_science_ects")

# Code, title; three SU credits and six ECTS each.
FALLBACK = (
    ("CS 300", "Data Structures"), ("CS 302", "Formal Languages and Automata Theory"), ("CS 307", "Operating Systems"), ("CS 310", "Mobile Application Development"),
    ("CS 455", "Deep Learning"), ("CS 555", "Advanced Deep Learning"),
)


def fallback(spark: SparkSession) -> DataFrame:
    """Courses where there are no pages."""
    rows = spark.createDataFrame(FALLBACK, "code string, title string")
    return rows.select("code", T.subject_of(F.col("code")).alias("subject"), T.number_of(F.col("code")).alias("number"), "title", F.lit("3").alias("su_credits"), F.lit("6").alias("ects"))


def seeds(lines: DataFrame) -> DataFrame:
    """Courses of page records (line_no, v: variant): one row a code, the last record of it; records without code or title make none."""
    raw = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    text = lambda name: T.store_clean(F.coalesce(raw(name), F.lit("")))
    either = lambda *found: F.coalesce(F.get(F.filter(F.array(*found), lambda x: x != ""), F.lit(0)), F.lit(""))  # noqa: E731  each is evaluated once
    rows = lines.select("line_no", "v", *[text(name).alias(name) for name in ("course_id", "subj_code", "parsed_subj_code", "crse_numb", "parsed_crse_numb", "title", "header_text")])
    rows = rows.select("line_no", "v", "course_id", either("subj_code", "parsed_subj_code").alias("subject"), either("crse_numb", "parsed_crse_numb").alias("number"), either("title", "header_text").alias("title"))
    rows = rows.withColumn("code", either("course_id", F.trim(F.concat("subject", F.lit(" "), "number"))))
    compact = r"^([A-Za-z]+)(\d.+)$"
    spaced = F.concat(F.upper(F.regexp_extract("code", compact, 1)), F.lit(" "), F.regexp_extract("code", compact, 2))
    rows = rows.withColumn("code", F.when(~F.contains(F.col("code"), F.lit(" ")) & F.col("code").rlike(compact), spaced).otherwise(F.col("code"))).where("code <> '' and title <> ''")
    done = rows.select(
        "line_no", "code", either("subject", T.subject_of(F.col("code"))).alias("subject"), either("number", T.number_of(F.col("code"))).alias("number"), "title",
        *[F.when(given(F.col("v"), name), raw(name)).alias(shown) for shown, name in zip(CREDITS, ("su_credits", "ects", "engineering", "basic_science"))], *[text(name).alias(name) for name in TEXTS[4:]],
    )
    return store.last_per_key(done, ["code"], ["line_no"]).drop("line_no")


def shown(courses: DataFrame, search: str = "", limit: int = 200) -> DataFrame:
    """The first courses by subject and number whose code, title or subject holds the search in any case; absent texts are empty."""
    found = courses
    if search.strip():
        low = F.lit(search.strip().lower())
        hit: Column = F.lit(False)
        for name in ("code", "title", "subject"):
            hit = hit | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), low)
        found = courses.where(hit)
    plain = found.select(*[F.coalesce(c, F.lit("")).alias(c) for c in TEXTS], *CREDITS)
    return plain.orderBy("subject", "number", "code").limit(limit)
