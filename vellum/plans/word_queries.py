"""Queries that apply the scalar functions to strings of the data itself: all words of all documents, order dates, order lines. Their SQL computes each result by rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_WORDS = r"(SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents) GROUP BY w)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different words of all documents and how often each stands there: counted before the shuffle, so frequent words are no hot keys."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    return table(spark, sf_dir, "documents").select(words.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


_UPPER = "replace(replace(upper({}), 'ß', 'SS'), 'ẞ', 'SS')"


@query(rf"""
WITH s AS (SELECT w, n, CASE WHEN regexp_full_match(w || n, '[A-Za-z]+[0-9](?s:.*)') THEN upper(regexp_extract(w || n, '^[A-Za-z]+')) || ' ' || regexp_replace(w || n, '^[A-Za-z]+', '') ELSE w || n END AS spaced,
  {_UPPER.format("w || n || 'a'")} AS code FROM {_WORDS})
SELECT w, spaced, array_to_string([spaced] || CASE WHEN contains(spaced, ' ') THEN [replace(spaced, ' ', '')] ELSE [] END
  || CASE WHEN lower(spaced) <> spaced THEN [lower(spaced)] || CASE WHEN contains(spaced, ' ') THEN [lower(replace(spaced, ' ', ''))] ELSE [] END ELSE [] END, '|') AS aliases,
  code, CASE WHEN regexp_matches(code, '^[A-Z]+[0-9]') THEN regexp_replace(code, '^([A-Z]+)', '\1 ') ELSE code END AS shown, w AS subject, n || ' z' AS number, CASE WHEN n % 2 = 0 THEN w || ' ' || n ELSE w END AS joined
FROM s""")
def word_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its count behind it as a course code: spaced, its aliases, cleaned, shown, split and joined."""
    w, n = F.col("w"), F.col("n").cast("string")
    return _words(spark, sf_dir).select(
        "w", T.spaced_course_id(F.concat(F.lit(" "), w, n)).alias("spaced"), F.array_join(T.course_aliases(F.concat(w, n)), "|").alias("aliases"),
        T.clean_code(F.concat(w, F.lit(" \t"), n, F.lit("a\n"))).alias("code"), T.display_code(F.concat(w, F.lit(" "), n, F.lit("a"))).alias("shown"),
        T.subject_of(F.concat(w, F.lit(" "), n, F.lit(" z"))).alias("subject"), T.number_of(F.concat(w, F.lit(" "), n, F.lit(" z"))).alias("number"),
        T.course_id(w, F.when(F.col("n") % 2 == 0, n)).alias("joined"),
    )


_TAILS = ("", "", *(needle for needles in T.REQUIREMENT_NEEDLES.values() for needle in needles), "Core Area", "FREE required")
_KINDS = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(low, '{x}')" for x in needles)} THEN '{kind}'" for kind, needles in T.REQUIREMENT_NEEDLES.items()) + " ELSE low END"


@query(rf"""
SELECT w, {_KINDS} AS requirement, coalesce(nullif(array_to_string(list_transform(list_filter(string_split(w, ''), lambda x: regexp_full_match(x, '[A-Za-z]')),
    lambda x: CASE upper(x) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.DAYS.items())} ELSE x END), '/'), ''), w) AS days,
  CASE WHEN kept = '' THEN 'upload.txt' ELSE kept END AS file, 'm_p_unknown_' || sha256(w) AS cache_key
FROM (SELECT w, lower(w || [{', '.join(f"'{x}'" for x in _TAILS)}][CAST(n % {len(_TAILS)} AS INTEGER) + 1]) AS low,
  regexp_replace(regexp_replace(regexp_extract('/x y/' || w || CASE WHEN n % 3 = 0 THEN '' ELSE '?' || n || '.pdf' END, '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS kept FROM {_WORDS})""")
def word_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word as a requirement's category (two of three with something that names one), as letters of days, as a file's name, and as a cached text."""
    w, n = F.col("w"), F.col("n")
    tail = F.get(F.array(*[F.lit(x) for x in _TAILS]), (n % len(_TAILS)).cast("int"))
    named = F.concat(F.lit("/x y/"), w, F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("?"), n, F.lit(".pdf"))))
    return _words(spark, sf_dir).select(
        "w", T.requirement_type(F.concat(w, tail)).alias("requirement"), T.readable_days(w).alias("days"), T.safe_filename(named).alias("file"),
        T.embedding_cache_key(F.lit(" m:p "), F.lit(None).cast("string"), w).alias("cache_key"),
    )


@query(f"""
SELECT o_orderkey, CASE WHEN length(code) <> 6 THEN '' ELSE {{0}} || ' ' || substr(code, 1, 4) || '-' || (CAST(substr(code, 1, 4) AS INTEGER) + 1) || ' (' || {{1}} || ')' END AS term
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y%m') END AS code FROM orders)""".format(*[f"CASE substr(code, 5, 2) {' '.join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in T.SEASONS.items())} ELSE 'Unknown' END" for i in (0, 1)]))
def order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and month of every order as a term's code; some are too short for one."""
    date = F.col("o_orderdate")
    code = F.when(F.col("o_orderkey") % 7 == 0, F.date_format(date, "yyyy")).otherwise(F.date_format(date, "yyyyMM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.term_name(code).alias("term"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN page IS NOT NULL THEN 'p' || page WHEN slide IS NOT NULL THEN 's' || slide WHEN section <> '' THEN 'sec-' || substr(section, 1, 20) ELSE '' END AS place,
  name || CASE WHEN page IS NOT NULL THEN ', page ' || page ELSE '' END || CASE WHEN slide IS NOT NULL THEN ', slide ' || slide ELSE '' END || CASE WHEN section <> '' THEN ', section ''' || section || '''' ELSE '' END AS label,
  '[Source: ' || name || CASE WHEN page IS NOT NULL THEN ', page ' || page ELSE '' END || ']' || chr(10) || section AS header
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS page, CASE WHEN l_linestatus = 'O' THEN l_suppkey END AS slide,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag || ' section of part ' || l_partkey END AS section, 'file ' || l_suppkey AS name FROM lineitem)""")
def line_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a place in a file: with a page, a slide, a section, several of them, or none."""
    page, slide = F.when(F.col("l_returnflag") == "R", F.col("l_partkey")), F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))
    section = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat("l_returnflag", F.lit(" section of part "), "l_partkey"))
    name = F.concat(F.lit("file "), "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", T.location_key(page, slide, section).alias("place"), T.source_label(name, page, slide, section).alias("label"), T.with_header(section, name, page).alias("header"),
    )
