"""Queries that apply the scalar functions and the record sources to values made of the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.plans import answers, courses
from vellum.sources import documents as sources
from vellum.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(r"""
SELECT c_custkey AS k, c_name || '  a b ' || c_mktsegment AS normalized, CASE c_custkey % 6 WHEN 0 THEN '3' WHEN 1 THEN 'True' WHEN 2 THEN '' WHEN 3 THEN '2.5' WHEN 4 THEN 'x y' ELSE '' END AS cleaned, 'a ' || c_name || ' b' AS stored
FROM customer""")
def cleaning_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    tokens = F.array(*[F.lit(x) for x in ("3.0", "true", "null", "2.5", " x \t y\n")], F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), T.normalize_text(F.concat(name, F.lit("\r\n  a\t\tb\n\n"), "c_mktsegment", F.lit(" \n"))).alias("normalized"),
        T.clean_value(F.get(tokens, (k % 6).cast("int"))).alias("cleaned"), T.store_clean(F.concat(F.lit("  a\n "), name, F.lit("\t b "))).alias("stored"),
    )


@query(r"""
SELECT c_custkey AS k, 'CS ' || c_custkey || '|CS' || c_custkey || '|cs ' || c_custkey || '|cs' || c_custkey AS aliases, 'CS' AS subject, c_custkey || ' x' AS number, CASE WHEN c_custkey % 2 = 0 THEN 'CS ' || c_custkey ELSE 'CS' END AS joined,
  'CS' || c_custkey || 'A' AS code, 'CS ' || c_custkey || 'A' AS shown, CASE c_custkey % 7 WHEN 0 THEN 'required' WHEN 1 THEN 'core' WHEN 2 THEN 'area' WHEN 3 THEN 'free' WHEN 4 THEN 'university' WHEN 5 THEN 'other x' ELSE 'unknown' END AS requirement
FROM customer""")
def course_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    kinds = F.array(*[F.lit(x) for x in ("Zorunlu Dersler", "Core Electives", "alan secmeli", "Serbest", "UNIVERSITE dersi", "Other X", "")])
    given = F.concat(F.lit("cs"), k)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.array_join(T.course_aliases(given), "|").alias("aliases"), T.subject_of(F.concat(F.lit("CS "), k, F.lit(" x"))).alias("subject"), T.number_of(F.concat(F.lit("CS "), k, F.lit(" x"))).alias("number"),
        T.course_id(F.lit(" CS "), F.when(F.col("c_custkey") % 2 == 0, k)).alias("joined"), T.clean_code(F.concat(F.lit(" cs "), k, F.lit("\ta"))).alias("code"), T.display_code(F.concat(given, F.lit("a"))).alias("shown"),
        T.requirement_type(F.get(kinds, (F.col("c_custkey") % 7).cast("int"))).alias("requirement"),
    )


@query(r"""
SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'upload.txt' ELSE 'b_c_' || c_custkey || '.txt' END AS file, CASE c_custkey % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'exam' ELSE 'course' END AS kind,
  CASE c_custkey % 4 WHEN 0 THEN 'p' || c_custkey WHEN 1 THEN 's' || c_custkey WHEN 2 THEN 'sec-' || substr(c_name, 1, 20) ELSE '' END AS place,
  c_name || CASE c_custkey % 4 WHEN 0 THEN ', page ' || c_custkey WHEN 1 THEN ', slide ' || c_custkey WHEN 2 THEN ', section ''' || c_name || '''' ELSE '' END AS label,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_custkey || '.5' END AS credit, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS shown, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'none' END AS chosen
FROM customer""")
def label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    only = lambda i, c: F.when(k % 4 == i, c)
    kinds = F.array(*[F.lit(x) for x in (" WhatsApp ", "exam_pdf", "notes", "")])
    page, slide, section = only(0, k), only(1, k), only(2, name)
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), T.safe_filename(F.when(k % 3 == 0, F.lit("/x/._.")).otherwise(F.concat(F.lit("/a/.b c?"), k, F.lit(".txt")))).alias("file"), T.document_type(F.get(kinds, (k % 4).cast("int"))).alias("kind"),
        T.location_key(page, slide, section).alias("place"), T.source_label(name, page, slide, section).alias("label"),
        T.format_credit(F.when(k % 5 == 0, k.cast("double")).otherwise(k + 0.5)).alias("credit"), T.maybe(name, k % 2 == 0).alias("shown"), T.or_else(F.when(k % 2 == 0, name).otherwise(""), F.lit("none")).alias("chosen"),
    )


@query(r"""
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'section A; CRN ' || s_suppkey || '; instructor(s): ' || s_name || '; meetings: M 9:40, W'
  ELSE 'section A; CRN ' || s_suppkey || '; instructor(s): ' || s_name || '; meetings: M 9:40, W | CRN 7' END AS summary,
  'Intent: ders_onerisi' || chr(10) || chr(10) || 'Context:' || chr(10) || '[Source: ' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN ', page ' || s_suppkey ELSE '' END || ']' || chr(10) || 'body' || chr(10) || chr(10) || 'Question: why' AS prompt
FROM supplier""")
def answer_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    meeting = lambda who, days, time: F.struct(who.alias("instructors"), F.lit(days).alias("days"), F.lit(time).cast("string").alias("time"))
    first = F.struct(F.lit("A").alias("section"), k.cast("string").alias("crn"), F.array(meeting(F.concat(name, F.lit(" ( P )")), "M", "9:40"), meeting(name, "W", None)).alias("meetings"))
    bare = F.struct(F.lit("").alias("section"), F.lit("7").alias("crn"), F.slice(F.array(meeting(name, "M", None)), 1, 0).alias("meetings"))
    found = F.when(k % 3 == 1, F.array(first)).when(k % 3 == 2, F.array(first, bare, first)).otherwise(F.slice(F.array(first), 1, 0))
    context = T.with_header(F.lit("body"), name, F.when(k % 2 == 0, k))
    return table(spark, sf_dir, "supplier").select(k.alias("k"), answers.meeting_summary(found).alias("summary"), answers.prompt(F.lit("why"), F.lit("ders_onerisi"), context).alias("prompt"))


_CELLS = "array<struct<cell_type:string,source:array<string>>>"


@query(r"""
SELECT 'n' || p_partkey AS path, CAST(ord AS INTEGER) AS ord, CASE ord WHEN 0 THEN NULL WHEN 1 THEN p_name ELSE CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END END AS section,
  CASE ord WHEN 0 THEN 'Notebook note:' || chr(10) || 'intro ' || p_partkey WHEN 1 THEN 'under it' || chr(10) || chr(10) || 'Code example:' || chr(10) || 'x = 1' || chr(10) || 'y = 2' ELSE 'Code example:' || chr(10) || p_brand END AS text
FROM part, (VALUES (0), (1), (2)) AS v(ord)""")
def notebook_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notebook a part: a note, a heading with text and code, and a second heading, which is nameless in every other one."""
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    cell = lambda kind, *lines: F.struct(F.lit(kind).alias("cell_type"), F.array(*lines).alias("source"))
    cells = F.array(cell("markdown", F.concat(F.lit("intro "), k)), cell("markdown", F.concat(F.lit("## "), name, F.lit("\n")), F.lit("under it")), cell("code", F.lit("x = 1\n"), F.lit("y = 2")), cell("code", F.lit(" \n")), cell("markdown", F.when(k % 2 == 0, F.concat(F.lit("# "), brand)).otherwise("#")), cell("code", brand))
    docs = table(spark, sf_dir, "part").select(F.concat(F.lit("n"), k).alias("path"), F.to_json(F.struct(cells.alias("cells"))).alias("text"))
    return sources.notebook(docs).select("path", F.col("ord").cast("int").alias("ord"), "section", "text")


@query(r"""
WITH items AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand AS path, CAST(i // 25 AS INTEGER) AS ord, 'items ' || (i // 25 * 25 + 1) || '-' || least((i // 25 + 1) * 25, any_value(n)) AS section, '[' || chr(10) || string_agg('  {' || chr(10) || '    "k": ' || p_partkey || chr(10) || '  }', ',' || chr(10) ORDER BY i) || chr(10) || ']' AS text FROM items GROUP BY p_brand, i // 25""")
def json_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON list a brand, 25 items a record."""
    items = F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"))))
    docs = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path")).agg(F.to_json(items).alias("text"))
    return sources.json_groups(docs).select("path", F.col("ord").cast("int").alias("ord"), "section", "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course page records of the parts: every tenth repeats the course before it, and every seventh has no title."""
    k = F.col("p_partkey")
    page = F.struct(
        F.when(k % 3 == 0, F.concat(F.lit("cs"), k + 1000)).alias("course_id"), F.when(k % 3 > 0, F.when(k % 10 == 0, F.lit("EE ")).otherwise("MATH")).alias("subj_code"), F.when(k % 10 == 0, k - 1).otherwise(k).alias("crse_numb"),
        F.when(k % 7 > 0, F.concat(F.lit(" "), "p_name", F.lit("\n x"))).alias("title"), F.col("p_size").alias("su_credits"), F.when(k % 2 == 0, F.col("p_size") / 2).alias("engineering"), F.col("p_brand").alias("description"),
    )
    return table(spark, sf_dir, "part").select(k.alias("line_no"), F.parse_json(F.to_json(page)).alias("v"))


_SEEDS = """
WITH p AS (SELECT p_partkey AS k, p_name || ' x' AS title, p_size AS s, p_brand AS b, CASE WHEN p_partkey % 3 = 0 THEN 'CS ' || (p_partkey + 1000) WHEN p_partkey % 10 = 0 THEN 'EE ' || (p_partkey - 1) ELSE 'MATH ' || p_partkey END AS code FROM part WHERE p_partkey % 7 > 0),
c AS (
  SELECT code, CASE WHEN k % 3 = 0 THEN 'CS' ELSE string_split(code, ' ')[1] END AS subject, CASE WHEN k % 10 = 0 THEN CAST(k - 1 AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS number, title, '' || s AS su_credits, CAST(NULL AS VARCHAR) AS ects,
    CASE WHEN k % 2 = 0 THEN (s // 2) || CASE WHEN s % 2 = 1 THEN '.5' ELSE '' END END AS engineering_ects, CAST(NULL AS VARCHAR) AS basic_science_ects, b AS description, '' AS prerequisites, '' AS corequisites, '' AS source_url,
    row_number() OVER (PARTITION BY code ORDER BY k DESC) AS rn FROM p)
SELECT * EXCLUDE (rn) FROM c WHERE rn = 1"""


@query(_SEEDS)
def course_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return courses.seeds(_pages(spark, sf_dir))


@query(f"SELECT * FROM ({_SEEDS}) WHERE contains(lower(code || chr(10) || title || chr(10) || subject), 'ee') ORDER BY subject, number, code LIMIT 200")
def course_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the first 200 courses that a search finds."""
    return courses.shown(courses.seeds(_pages(spark, sf_dir)), " EE ")


@query("SELECT c_custkey AS k, 'a_b_unknown_' || sha256(c_name) AS cache_key FROM customer")
def embedding_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), T.embedding_cache_key(F.lit(" a:b "), F.lit(""), F.col("c_name")).alias("cache_key"))


@query("SELECT event_id, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE printf('%.1f', v) END AS credit FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE event_id / 20.0::DOUBLE END AS v FROM events)")
def credit_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of all events, and multiples of 0.05, half of which lie beside or at a border of rounding."""
    value = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(F.col("event_id") / 20.0)
    return table(spark, sf_dir, "events").select("event_id", T.format_credit(value).alias("credit"))
