"""Queries of what stands around an answer: chat batches, expanded questions, context cards, citations, cleaned texts, with their SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.plans import answers, lifecycle
from vellum.plans.queries import _S, _WHOLE_AREA, _begins, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _said(template: str, *columns: str) -> str:
    """SQL for a template with the columns put in."""
    first, *rest = template.split("{}")
    return " || ".join([_quoted(first), *(f"{c} || {_quoted(x)}" for c, x in zip(columns, rest, strict=True))])


def _case(column: str, values: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_quoted(k)} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def _stripped(column: str) -> str:
    return f"regexp_replace({column}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as the messages of an export a conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("author"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.withColumn("index", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "author", "text")) - 1).cast("long"))


_TURNS = "SELECT conv_id, coalesce(role, '') AS author, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations"


@query(f"""
SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE i < 8) AS n_preview, sha256(string_agg(text, chr(10) ORDER BY i)) AS whole, sha256(string_agg(text, chr(30) ORDER BY i) FILTER (WHERE i < 8)) AS preview
FROM ({_TURNS}) GROUP BY conv_id""")
def chat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, preview and whole text of the batch that each conversation is."""
    told = lifecycle.summaries(_messages(spark, sf_dir), ["conv_id"])
    return told.select("conv_id", F.col("messageCount").alias("n"), F.size("preview").cast("long").alias("n_preview"), F.sha2("text", 256).alias("whole"), F.sha2(F.array_join("preview", "\x1e"), 256).alias("preview"))


@query(f"""
SELECT 'review:' || substr(sha256('review:' || conv_id || ':' || i || ':' || text), 1, 24) AS review_id, 'whatsapp:' || conv_id AS batch_id, author, length(text) AS n_chars, 'approved' AS status FROM ({_TURNS})""")
def chat_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review that each message of an approved batch becomes."""
    named = {"sourceId": F.concat(F.lit("review:"), "conv_id"), "uploadBatchId": F.concat(F.lit("whatsapp:"), "conv_id"), "date": F.lit("1.2.2024")}
    rows = lifecycle.review_rows(_messages(spark, sf_dir).withColumns(named))
    return rows.select(F.col("reviewId").alias("review_id"), F.col("uploadBatchId").alias("batch_id"), "author", F.length("text").cast("long").alias("n_chars"), "status")


#: What is put behind the turns, so that they name areas; every fifth conversation says nothing else.
_TAILS = ("", "nlp", " Yapay  Zeka", " data science", "siber güvenlik", " cloud nedir", " frontend", " hoca kim, chatbot", " security mi?")
_INTENTS = ("ders_onerisi", *answers.SUFFIXES, "ders_onerisi", "diger")


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as questions, with an intent and the courses taken by number."""
    nth = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))
    conv, turn = F.col("conv_id"), F.col("turn")
    asked = F.concat(F.when(conv % 5 == 0, "").otherwise(F.coalesce("text", F.lit(""))), nth(_TAILS, conv + turn))
    taken = F.when(conv % 3 == 1, F.array(F.concat(F.lit("CS"), 400 + conv % 60))).when(conv % 3 == 2, F.array(F.concat(F.lit("cs "), 400 + conv % 60), F.lit("EE417"), F.concat(F.lit("CS"), 400 + conv % 60)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("question"), nth(_INTENTS, F.floor(conv / 5) + turn).alias("intent"), taken.alias("taken"))


_LABELS = {key: _quoted(label) for key, (label, _) in answers.INTERESTS.items()}
_NAMED = "[" + ", ".join(_quoted(n) for _, names in answers.INTERESTS.values() for n in names) + "]"
_SHORT = f"(list_contains({_NAMED}, plain) OR (length(plain) <= 120 AND area IS NOT NULL AND NOT {_begins(answers.NOT_RECOMMENDATION, True, 'plain')}))"
_AREAS = f"""
q AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN '' ELSE coalesce(text, '') END || [{', '.join(map(_quoted, _TAILS))}][CAST((conv_id + turn) % {len(_TAILS)} AS INTEGER) + 1] AS question,
  [{', '.join(map(_quoted, _INTENTS))}][CAST((conv_id // 5 + turn) % {len(_INTENTS)} AS INTEGER) + 1] AS intent, 400 + conv_id % 60 AS number FROM conversations),
p AS (SELECT *, regexp_replace({_stripped('lower(question)')}, '[{_S}]+', ' ', 'g') AS plain FROM q),
a AS (SELECT *, {_WHOLE_AREA} AS area FROM p),
l AS (SELECT *, {_case('area', _LABELS)} AS label, {_SHORT} AS short,
  CASE conv_id % 3 WHEN 1 THEN 'CS' || number WHEN 2 THEN 'cs ' || number || ', EE417, CS' || number ELSE 'none' END AS taken, CASE conv_id % 3 WHEN 1 THEN 'CS ' || number WHEN 2 THEN 'CS ' || number || ', EE 417' ELSE 'none' END AS shown FROM a)"""
_HINTED = {key: _quoted(" ".join(codes)) for key, codes in answers.HINTS.items()}
_SPACED = {key: _quoted(", ".join(re.sub(r"^([A-Z]+)", r"\1 ", c) for c in codes)) for key, codes in answers.HINTS.items()}


def _digest(c: Column) -> Column:
    return F.sha2(c, 256)


@query(f"""
WITH {_AREAS},
e AS (SELECT *, CASE WHEN label IS NULL THEN question
  WHEN short THEN {_said("{} alanında gelecek dönem için 5 derslik ders programı öner. Öğrencinin aldığı dersleri tekrar önerme. Kullanıcının ilgi ayrıntısı: {}", "label", "question")}
  ELSE question || chr(10) || chr(10) || {_said("Çıkarılan ilgi alanı: {}. Bu alan için 5 derslik program öner; alınmış dersleri tekrar önerme.", "label")} END AS expanded FROM l)
SELECT conv_id, turn, intent, sha256({_case('intent', {'ders_onerisi': f"expanded || ' ' || {_case('area', _HINTED, "''")} || ' course recommendation Sabanci CS BSCS course catalog core electives area electives free electives schedule instructors {answers.TERM} AI NLP Data Web Systems Security'", **{k: f"question || {_quoted(' ' + v)}" for k, v in answers.SUFFIXES.items()}}, 'question')}) AS query
FROM e""")
def expanded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched for each turn, over all intents and areas."""
    return _areas(spark, sf_dir).select("conv_id", "turn", "intent", _digest(answers.retrieval_query(F.col("question"), F.col("intent"))).alias("query"))


_TOLD = {name: _said(text, "taken") if "{}" in text else _quoted(text) for name, text in answers.INTENT_TEXTS.items()}


@query(f"""
WITH {_AREAS}
SELECT conv_id, turn, sha256('[Source: Request intent]' || chr(10) || {_case('intent', _TOLD, _said("Detected intent: {}. Answer only this academic intent using the retrieved context.", "intent"))}) AS card,
  CASE WHEN area IS NOT NULL THEN sha256({_said(answers.STRATEGY, "label", f"({_case('area', _SPACED)})", "shown")}) END AS strategy,
  sha256({_said(answers.ASK_TO_RECOMMEND, "coalesce(label, 'the requested area')", "taken", "question")}) AS asked
FROM l""")
def context_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intent's card, the strategy of the area, and the question that is put, for each turn."""
    q, intent, taken = F.col("question"), F.col("intent"), F.col("taken")
    return _areas(spark, sf_dir).select("conv_id", "turn", _digest(answers.intent_context(intent, taken)).alias("card"), _digest(answers.strategy(q, taken)).alias("strategy"), _digest(answers.recommendation_question(q, taken)).alias("asked"))


_OPENINGS = ("", "  Öncelikle mezuniyet durumunu {}, sonra.\n\n", "MEZUNIYET DURUMUNU {}\n", "öncelikle Mezuniyet Durumunu {}. Mezuniyet durumunu yine.  ", "Sonuç: mezuniyet durumunu {}. ")
_SCRUBBED = "said"
for _opening in answers.SCRUBBED:
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '(?i)^[{_S}]*{_opening}[^.\\n]*(?:\\.|\\n)[{_S}]*', '')"


@query(f"""
SELECT doc_id, sha256(clean) AS digest, length(clean) AS n FROM (SELECT doc_id, {_stripped(_SCRUBBED)} AS clean FROM (
  SELECT doc_id, [{', '.join(f"({_said(o, 'doc_id') if '{}' in o else _quoted(o)})" for o in _OPENINGS)}][CAST(doc_id % {len(_OPENINGS)} AS INTEGER) + 1] || coalesce(text, '') AS said FROM documents))""")
def scrubbed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as answers, four of five with an opening, three of which go."""
    openings = F.array(*[F.concat(*[x for part in o.split("{}") for x in (F.lit(part), F.col("doc_id"))][:-1]) for o in _OPENINGS])
    said = F.concat(F.get(openings, (F.col("doc_id") % len(_OPENINGS)).cast("int")), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", answers.scrub(said).alias("clean")).select("doc_id", _digest(F.col("clean")).alias("digest"), F.length("clean").cast("long").alias("n"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE s_name END AS label FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey % 40),
f AS (SELECT l_orderkey, label, min(l_linenumber) AS place FROM c GROUP BY ALL)
SELECT l_orderkey, coalesce(string_agg(label, '|' ORDER BY place, label) FILTER (WHERE coalesce(label, '') <> ''), '') AS labels FROM f GROUP BY l_orderkey""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contexts of their lines: the sources that each cites, some of which are repeated, empty or unknown."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("position"), (F.col("l_suppkey") % 40).alias("k")).join(names, "k", "left")
    told = answers.cited_many(lines.withColumn("source", F.when(F.col("position") % 5 == 0, "").otherwise(F.col("s_name"))), ["l_orderkey"])
    return told.select("l_orderkey", F.array_join("labels", "|").alias("labels"))


@query(rf"""
SELECT doc_id, sha256({_stripped(r"regexp_replace(regexp_replace(replace(said, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n+', ' ', 'g')")}) AS normalized, sha256({_stripped(f"regexp_replace(said, '[{_S}]+', ' ', 'g')")}) AS stored
FROM (SELECT doc_id, '  ' || replace(text, '. ', ' ' || chr(9) || '.' || chr(13) || chr(10) || chr(10) || chr(160)) AS said FROM documents)""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with dirt put in, by the two cleaners that work on one line."""
    said = F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(" \t.\r\n\n ")))
    return table(spark, sf_dir, "documents").select("doc_id", _digest(T.normalize_text(said)).alias("normalized"), _digest(T.store_clean(said)).alias("stored"))


@query(r"""
SELECT event_id, CASE WHEN regexp_full_match(token, '-?\d+\.0+') THEN split_part(token, '.', 1) ELSE token END AS cleaned
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '-' ELSE '' END || user_id || '.' || lpad(CAST(event_id % 20 AS VARCHAR), 2, '0') AS token FROM events)""")
def cleaned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as they stand in JSON, of all events; a twentieth are integral."""
    token = F.concat(F.when(F.col("event_id") % 3 == 0, "-").otherwise(""), F.col("user_id"), F.lit("."), F.lpad((F.col("event_id") % 20).cast("string"), 2, "0"))
    return table(spark, sf_dir, "events").select("event_id", T.clean_value(token).alias("cleaned"))
