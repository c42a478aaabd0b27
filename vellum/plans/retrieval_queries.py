"""Queries of retrieval for tables of questions, with their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators.trigrams import Index, scores
from vellum.plans import intent, retrieve
from vellum.plans.queries import _W, table
from vellum.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What is put behind the turns, so that they name programs, courses, requirements, lists and collections.
_TAILS = ("", " required CS courses", " EE core schedule", " CS 101 or ee-204 required", " graduation of the CS program", " semantic search, mandatory", " required EE 204 schedule", " CS elective")


def _strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


_TYPES = "CASE " + " ".join(f"WHEN {_any('low', needles)} THEN {_strings(kinds)}" for needles, kinds in intent.DOCUMENT_TYPES) + " ELSE [] END"
_REQUIREMENTS = "list_filter([" + ", ".join(f"CASE WHEN {_any('low', needles)} THEN '{kind}' END" for kind, needles in intent.REQUIREMENTS.items()) + "], lambda x: x IS NOT NULL)"
_PROGRAMS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(upper(question), '(^|[^{_W}]){p}($|[^{_W}])') THEN '{p}' END" for p in sorted(intent.PROGRAMS, key=lambda p: (-len(p), p))) + "], lambda x: x IS NOT NULL)"
_CODE = rf"'(?:^|[^{_W}])([A-Z]{{2,5}})\s*-?\s*(\d{{3}}[A-Z]?)\b'"
_LENGTH = "list_distance(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.vector, lambda x: CAST(x AS DOUBLE)))"

ORACLES["hybrid_retrieve_many"] = rf"""
WITH q AS (
  SELECT t.conv_id * 1000 + t.turn AS qid, coalesce(t.text, '') || {_strings(_TAILS)}[CAST((t.conv_id + t.turn) % {len(_TAILS)} AS INTEGER) + 1] AS question, v.embedding AS vector
  FROM conversations t JOIN embeddings v ON v.vec_id = (t.conv_id * 31 + t.turn) % 400 WHERE t.role = 'user'),
l AS (SELECT *, lower(question) AS low, list_transform(list_zip(regexp_extract_all(upper(question), {_CODE}, 1), regexp_extract_all(upper(question), {_CODE}, 2)), lambda z: z[1] || ' ' || z[2]) AS coded FROM q),
n AS (
  SELECT qid, low, list_filter(coded, lambda x, i: list_position(coded, x) = i) AS courses, {_REQUIREMENTS} AS requirements, {_TYPES} AS types, {_PROGRAMS} AS programs,
    {_any('low', intent.SOURCE_NEEDLES)} AS sources, {_any('low', intent.GRADUATION_NEEDLES)} AS graduation,
    list_filter(list_distinct(regexp_extract_all(low, '[a-z0-9]+')), lambda t: length(t) > 1) AS terms FROM l),
m AS (SELECT *, CASE WHEN len(requirements) > 0 THEN 1 ELSE 0 END AS r, len(requirements) + len(types) + len(programs) > 0 OR sources AS base, list_has_any(types, {_strings(retrieve.LIST_TYPES)}) AS listed FROM n),
s AS (
  SELECT qid, (i - 1) * (1 + r) AS branch, courses[i] AS course, true AS narrow, false AS aggregate FROM m, unnest(range(1, len(courses) + 1)) AS t(i)
  UNION ALL SELECT qid, (i - 1) * 2 + 1, courses[i], false, false FROM m, unnest(range(1, len(courses) + 1)) AS t(i) WHERE r = 1
  UNION ALL SELECT qid, 0, NULL, true, true FROM m WHERE base AND len(courses) = 0 AND listed
  UNION ALL SELECT qid, len(courses) * (1 + r) + CASE WHEN len(courses) = 0 AND listed THEN 1 ELSE 0 END, NULL, true, false FROM m WHERE base),
c AS (
  SELECT doc_id, text, v.embedding, CASE lang WHEN 'en' THEN 'program_requirement' WHEN 'de' THEN 'program_requirement_list' WHEN 'fr' THEN 'schedule_section' ELSE 'degree_requirement_profile' END AS kind,
    CASE WHEN d.doc_id % 5 < 3 THEN 'CS' ELSE 'EE' END AS program, CASE WHEN d.doc_id % 3 = 0 THEN 'required' ELSE 'core' END AS requirement,
    CASE d.doc_id % 7 WHEN 0 THEN 'CS 101' WHEN 1 THEN 'EE 204' END AS course, d.doc_id % 11 = 0 AS source, CASE WHEN d.doc_id % 13 = 0 THEN 'official_degree_evaluation' WHEN d.doc_id % 13 = 1 THEN 'official_degree_requirements' END AS authority, lang = 'de' AS aggregate
  FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id),
met AS (
  SELECT s.qid, s.branch, c.doc_id, coalesce(c.text, '') <> '' AS told, {_LENGTH.replace('v.embedding', 'c.embedding')} AS d
  FROM s JOIN m USING (qid) JOIN q USING (qid) JOIN c ON (s.course IS NULL OR c.course = s.course) AND (NOT s.narrow OR len(m.requirements) = 0 OR list_contains(m.requirements, c.requirement))
    AND (len(m.types) = 0 OR list_contains(m.types, c.kind)) AND (len(m.programs) = 0 OR list_contains(m.programs, c.program)) AND (NOT m.sources OR c.source) AND (NOT s.aggregate OR c.aggregate)),
hit AS (
  SELECT qid, doc_id, branch, 0 AS way, position FROM (SELECT *, row_number() OVER (PARTITION BY qid, branch ORDER BY doc_id) AS position FROM met WHERE told) WHERE position <= 60
  UNION ALL SELECT qid, doc_id, branch, 1, position FROM (SELECT *, row_number() OVER (PARTITION BY qid, branch ORDER BY d, doc_id) AS position FROM met WHERE d IS NOT NULL) WHERE position <= 20),
fallback AS (
  SELECT qid, doc_id, 0 AS branch, 1 AS way, position FROM (
    SELECT q.qid, v.vec_id AS doc_id, row_number() OVER (PARTITION BY q.qid ORDER BY {_LENGTH}, v.vec_id) AS position FROM q, embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents) AND q.qid NOT IN (SELECT qid FROM hit)) WHERE position <= 20),
one AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY branch, way, position) AS rn FROM (FROM hit UNION ALL FROM fallback)),
scored AS (
  SELECT one.*, CASE WHEN list_contains(m.courses, c.course) THEN 20 ELSE 0 END + CASE WHEN list_contains(m.programs, c.program) THEN 6 ELSE 0 END + CASE WHEN list_contains(m.requirements, c.requirement) THEN 4 ELSE 0 END
    + CASE WHEN m.graduation AND authority = 'official_degree_evaluation' THEN 14 WHEN m.graduation AND authority = 'official_degree_requirements' THEN 6 ELSE 0 END + CASE WHEN c.aggregate AND len(m.courses) = 0 THEN 1 ELSE 0 END
    + 0.25 * len(list_filter(m.terms, lambda t: contains(lower(coalesce(c.text, '')), t))) AS score
  FROM one JOIN m USING (qid) JOIN c USING (doc_id) WHERE rn = 1)
SELECT qid AS question_id, doc_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, branch, way, position) AS rank FROM scored) WHERE rank <= 20
"""


def question_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, with metadata by their numbers and languages, and vectors where there are any."""
    i, vectors = F.col("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    kind = F.when(F.col("lang") == "en", "program_requirement").when(F.col("lang") == "de", "program_requirement_list").when(F.col("lang") == "fr", "schedule_section").otherwise("degree_requirement_profile")
    return table(spark, sf_dir, "documents").join(vectors, "doc_id", "left").select(
        F.lpad(i.cast("string"), 20, "0").alias("chunk_id"), "text", "embedding", kind.alias("document_type"), F.when(i % 5 < 3, "CS").otherwise("EE").alias("program"),
        F.when(i % 3 == 0, "required").otherwise("core").alias("requirement_type"), F.when(i % 7 == 0, "CS 101").when(i % 7 == 1, "EE 204").alias("course_id"), F.when(i % 11 == 0, "sources").alias("source_collection"),
        F.when(i % 13 == 0, "official_degree_evaluation").when(i % 13 == 1, "official_degree_requirements").alias("source_authority"), (F.col("lang") == "de").alias("aggregate"),
    )


def turn_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns as questions."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAILS]), ((F.col("conv_id") + F.col("turn")) % len(_TAILS) + 1).cast("int"))
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat(F.coalesce("text", F.lit("")), tail).alias("question"), ((F.col("conv_id") * 31 + F.col("turn")) % 400).alias("vec_id"))
    return asked.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


def hybrid_retrieve_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns of all conversations, answered from all documents in one plan."""
    found = retrieve.retrieve_many(question_chunks(spark, sf_dir), turn_questions(spark, sf_dir), 20)
    return found.select("question_id", F.col("chunk_id").cast("long").alias("doc_id"), F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))


QUERIES["hybrid_retrieve_many"] = hybrid_retrieve_many


_PIECES = "list_transform(list_filter({tokens}, lambda t, i: list_position({tokens}, t) = i), lambda t: list_distinct(list_transform(range(1, length(t) + 1), lambda i: substr('^' || t || '$', CAST(i AS BIGINT), 3))))"
ORACLES["late_interaction"] = f"""
WITH q AS (
  SELECT conv_id * 1000 + turn AS qid, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS tokens, (conv_id * 7 + turn) % 50 % 5 AS part FROM conversations WHERE role = 'user'),
c AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS tokens FROM benchmark),
asked AS (SELECT qid, part, {_PIECES.format(tokens="tokens")} AS a FROM q),
told AS (SELECT item_id, {_PIECES.format(tokens="tokens")} AS b FROM c),
met AS (
  SELECT qid, item_id, a, b FROM asked JOIN told ON item_id % 5 = part),
best AS (SELECT qid, item_id, list_transform(a, lambda x: coalesce(list_max(list_transform(b, lambda y: len(list_intersect(x, y)) / sqrt(len(x) * CAST(len(y) AS DOUBLE)))), 0.0)) AS s FROM met),
scored AS (SELECT qid, item_id, round(CASE WHEN len(s) > 0 THEN list_sum(s) / len(s) ELSE 0 END, 6) AS score FROM best)
SELECT qid AS question_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM scored) WHERE rank <= 6
"""


def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the benchmark's items as candidates of each user turn, re-ranked by late interaction."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    questions = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"), ((F.col("conv_id") * 7 + F.col("turn")) % 50 % 5).alias("part"))
    chunks = table(spark, sf_dir, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 20, "0").alias("chunk_id"), "text", (F.col("item_id") % 5).alias("part"))
    found = questions.join(chunks, "part").select("question_id", "chunk_id", F.col("chunk_id").cast("long").alias("rank"))
    best = retrieve.rerank_many(chunks.drop("part"), questions, found, blend=0.0)
    return best.select("question_id", F.col("chunk_id").cast("long").alias("item_id"), F.col("rerank_score").alias("score"), F.col("rank").cast("int").alias("rank"))


QUERIES["late_interaction"] = late_interaction


_SOUGHT = ("license", "secret", "Password", "tion ", "the", "zz", "ß", "rights reserved", "nowhere to be found", "%_")
ORACLES["indexed_search"] = f"SELECT term, doc_id, sha256(text) AS digest FROM documents JOIN (SELECT unnest({_strings(_SOUGHT)}) AS term) ON contains(lower(text), lower(term))"


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a trigram index, searched for rare, common, short and absent terms."""
    index = Index(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}").build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return index.search(*_SOUGHT).select("term", F.col("id").alias("doc_id"), F.sha2("text", 256).alias("digest"))


ORACLES["indexed_lexical_score"] = """
SELECT doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT doc_id, 0.25 * len(list_filter(['password', 'secret', 'license', 'reserved'], lambda t: contains(lower(text), t))) AS score FROM documents) WHERE score > 0) WHERE rank <= 100"""


def indexed_lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the 100 documents with most of a query's terms, by the index."""
    index = Index(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}").build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    best = scores(index, ["password", "secret", "license", "reserved"]).orderBy(F.col("score").desc(), "id").limit(100)
    return best.select(F.col("id").alias("doc_id"), "score", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).cast("int").alias("rank"))


QUERIES |= {"indexed_search": indexed_search, "indexed_lexical_score": indexed_lexical_score}
