"""The queries over the driver's tables, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import cards, chunking, retrieval, store
from vellum.plans import answers, catalog, intent, retrieve
from vellum.sources import documents as sources
from vellum.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; those of long texts over all cores."""
    found = tables.table(spark, sf_dir, name)
    return tables.spread(found) if name in ("documents", "pages", "conversations") else found


def _probes(vectors: DataFrame, where: str) -> DataFrame:
    return vectors.where(where).select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))


_DISTANCE = "list_distance(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(p.embedding, lambda x: CAST(x AS DOUBLE)))"


@query(f"""
SELECT vec_id, label, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM (
  SELECT e.vec_id, e.label, d, row_number() OVER (ORDER BY d, e.vec_id) AS rank
  FROM (SELECT e.vec_id, e.label, {_DISTANCE} AS d FROM embeddings e, embeddings p WHERE p.vec_id = 0 AND e.label IN (0, 1, 2)) e)
WHERE rank <= 20""")
def dense_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = retrieval.dense_topk(vectors.where(retrieval.conjunction({"label": [0, 1, 2]})), _probes(vectors, "vec_id = 0"), 20)
    return found.select("vec_id", "label", F.col("rank").cast("int"), F.round("distance", 6).alias("distance"))


@query(f"""
SELECT vec_id, label, CAST(rank AS INTEGER) AS rank FROM (
  SELECT e.vec_id, e.label, row_number() OVER (PARTITION BY e.label ORDER BY {_DISTANCE}, e.vec_id) AS rank
  FROM embeddings e, embeddings p WHERE p.vec_id = 1) WHERE rank <= 8""")
def dense_topk_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.dense_topk(vectors, _probes(vectors, "vec_id = 1"), 8, ["label"]).select("vec_id", "label", F.col("rank").cast("int"))


@query(f"""
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT p.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY p.vec_id ORDER BY {_DISTANCE}, e.vec_id) AS rank
  FROM embeddings e, embeddings p WHERE p.vec_id % 100 = 0) WHERE rank <= 20""")
def batch_dense_topk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundredth of the vectors as queries, against all."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.dense_topk(vectors, _probes(vectors, "vec_id % 100 = 0"), 20).select(F.col("probe_id").alias("query_id"), "vec_id", F.col("rank").cast("int"))


@query("""
SELECT doc_id, sha256(text) AS digest, length(text) AS n FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(nfc_normalize('  ' || chr(160) || chr(8203) || replace(text, '. ', ' ' || chr(9) || ' .' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10)) || chr(65279)),
      '[' || chr(160) || chr(8203) || chr(8204) || chr(8205) || chr(65279) || ']', '', 'g'),
    '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents)""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    soiled = F.concat(F.lit("  \u00a0\u200b"), F.replace("text", F.lit(". "), F.lit(" \t .\r\n\n\n\n")), F.lit("\ufeff"))
    done = table(spark, sf_dir, "documents").select("doc_id", T.clean_text(soiled).alias("text"))
    return done.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n"))


#: Java's Unicode classes of word characters and white space, as DuckDB's patterns write them.
_W, _S = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}", r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _begins(words: str, closed: bool = False, column: str = "text") -> str:
    """SQL for: one of the words begins in the text, and with ``closed`` ends there too."""
    pattern = words.replace(r"\w", f"[{_W}]").replace(r"\s", f"[{_S}]").replace(r"\d", r"\p{Nd}").replace("'", "''")
    return f"regexp_matches({column}, '(?i)(^|[^{_W}])({pattern})" + (f"($|[^{_W}])" if closed else "") + "')"


@query(rf"""
SELECT doc_id, sha256(said) AS digest, CAST(said <> text AS INTEGER) AS changed FROM (
  SELECT doc_id, text, regexp_replace(regexp_replace(text, '[{_W}.+-]+@[{_W}-]+\.[{_W}.-]+|\+?\p{{Nd}}[\p{{Nd}}{_S}().-]{{7,}}\p{{Nd}}', '[redacted]', 'g'), '^[{_S}]+|[{_S}]+$', '', 'g') AS said
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""")
def pii_redact_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return _redacted(table(spark, sf_dir, "documents"))


def _redacted(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("digest"), (T.redact(F.col("text")) != F.coalesce("text", F.lit(""))).cast("int").alias("changed"))


@query()
def chat_parse_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations as chat exports, every second turn in the bracket form, with their lines as continuations, parsed back; DuckDB can't express it, as texts hold lines that look like heads."""
    return _reparsed(table(spark, sf_dir, "conversations"))


def _reparsed(rows: DataFrame) -> DataFrame:
    """Turns written as chat exports, every second in the bracket form, and parsed."""
    head = F.when(F.col("turn") % 2 == 0, F.lit("[1.2.2024 10:15] ")).otherwise(F.lit("1.2.2024, 10:15 AM - "))
    lines = rows.withColumn("line", F.concat(head, F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))))
    exports = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return sources.chat(exports, ["conv_id"]).select("conv_id", "index", "author", F.length("text").cast("long").alias("n_chars"), "date")


@query()
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.html(table(spark, sf_dir, "pages"), "page_id")


@query("""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
marked AS (SELECT *, sum(CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM lines)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, sha256(body) AS digest FROM (
  SELECT doc_id, ord, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS body FROM marked WHERE i % 3 <> 0 GROUP BY doc_id, ord)
WHERE body <> ''""")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    found = sources.sections(lines, ["doc_id"], "i", "line", F.col("i") % 3 == 0, F.col("line"))
    return found.select("doc_id", "ord", F.sha2("text", 256).alias("digest"))


@query("""
WITH pieces AS (
  SELECT doc_id, i AS chunkIndex, substr(text, CAST(i * 500 + 1 AS BIGINT), 500) AS piece, 'course:' || substr(sha256(text), 1, 24) AS sourceId
  FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents WHERE text <> ''))
SELECT doc_id, chunkIndex, sourceId || ':' || chunkIndex || ':' || substr(sha256(piece), 1, 16) AS chunkId FROM pieces""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text <> ''").withColumn("sourceId", T.source_id(F.lit("course"), T.content_hash(F.col("text"))))
    index = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(length(text) + 499) div 500 - 1"))).alias("chunkIndex")
    pieces = docs.select("doc_id", "sourceId", "text", index).withColumn("piece", F.substr("text", (F.col("chunkIndex") * 500 + 1).cast("int"), F.lit(500)))
    return pieces.select("doc_id", "chunkIndex", T.chunk_id(F.col("sourceId"), F.col("chunkIndex"), F.col("piece")).alias("chunkId"))


@query()
def split_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    records = table(spark, sf_dir, "documents").select("doc_id", "text", none.cast("string").alias("source_hash"), F.lit("course").alias("document_type"), none.cast("int").alias("page"), none.cast("int").alias("slide"), none.cast("string").alias("section"), F.col("doc_id").alias("ord"))
    return chunking.chunks(records).select("doc_id", "sourceId", "chunkIndex", "chunkId", F.length("chunk").alias("n_chars"))


_CARDS = """
WITH n AS (SELECT {keys}, {entry} AS entry, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY {keys}) AS n_entries FROM {table})
SELECT {keys}, n_entries, CAST((rn - 1) // {size} + 1 AS BIGINT) AS part, sha256(string_agg(entry, chr(10) ORDER BY rn)) AS digest, count(*) AS n_in_card
FROM n GROUP BY {keys}, n_entries, part"""


@query(_CARDS.format(keys="p_brand", entry="p_name || ' (' || p_type || ')'", order="p_name, p_partkey", table="part", size=70))
def group_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cards.grouped(table(spark, sf_dir, "part"), ["p_brand"], ["p_name", "p_partkey"], F.format_string("%s (%s)", "p_name", "p_type"), 70)
    return made.select("p_brand", "n_entries", "part", F.sha2("body", 256).alias("digest"), "n_in_card")


@query(_CARDS.format(keys="l_returnflag, l_suppkey", entry="l_orderkey || '-' || l_linenumber", order="l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice", table="lineitem", size=20))
def schedule_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cards.grouped(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")), 20)
    return made.select("l_returnflag", "l_suppkey", "n_entries", "part", F.sha2("body", 256).alias("digest"), "n_in_card")


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_custkey, CAST(i // 4 + 1 AS BIGINT) AS part, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS items FROM n GROUP BY o_custkey, part""")
def history_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("items"))
    return cards.sliced(rows, ["o_custkey"], "items", 4).select("o_custkey", "part", F.array_join("items", ",").alias("items"))


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def nested_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("lines"))
    nested = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return nested.select(F.col("o_orderkey").alias("order_id"), F.explode("lines").alias("x")).select("order_id", F.col("x.l_linenumber").alias("line"), F.col("x.l_partkey").alias("part"), F.col("x.l_quantity").alias("quantity"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
SELECT user_id, round(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)), 4) AS total,
  round(greatest(125 - sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)), 0), 4) AS remaining, count(*) AS n FROM events GROUP BY user_id""")
def sum_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    credit = F.sum(T.su_credit(F.get_json_object("props", "$.k")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(credit, 4).alias("total"), F.round(F.greatest(F.lit(125) - credit, F.lit(0)), 4).alias("remaining"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT lang, source, n, first_seen, CAST(row_number() OVER (ORDER BY n DESC, first_seen) AS INTEGER) AS rank
FROM (SELECT lang, source, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY lang, source)""")
def count_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id").select("lang", "source", "n", "first_seen", F.col("rank").cast("int"))


@query("SELECT source, count(*) AS chunks, arg_max(lang, doc_id) AS name FROM documents GROUP BY source")
def per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a source's chunks: their number, and the last one's name."""
    return store.totals(table(spark, sf_dir, "documents").withColumnRenamed("lang", "name"), "source", "name", "doc_id")


@query("""
SELECT p_brand AS owner, p_partkey AS id, 'kept' AS origin FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part)
UNION ALL SELECT (SELECT min(p_brand) FROM part), p_partkey, 'requested' FROM part WHERE p_partkey IN (SELECT l_suppkey * 3 FROM lineitem)""")
def requested_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as links of their brand; the first brand's are replaced by requested ids, of which those that are parts count."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_partkey").alias("id"), F.lit("kept").alias("origin"))
    first = parts.agg(F.min("owner")).first()[0]
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 3).alias("id"))
    wanted = store.requested(asked, parts, "id").select(F.lit(first).alias("owner"), "id", F.lit("requested").alias("origin"))
    return store.replace_links(parts, "owner", first, wanted)


@query("""
SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an') OR contains(lower(p_type), 'an')
ORDER BY p_brand, p_name, p_partkey LIMIT 200""")
def search_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.search(table(spark, sf_dir, "part"), "AN", ["p_name", "p_brand", "p_type"]).orderBy("p_brand", "p_name", "p_partkey").limit(200).select("p_partkey", "p_name", "p_brand")


@query("""
SELECT doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT doc_id, 0.25 * len(list_filter(['the', 'tion', 'secret', 'license', 'of'], lambda t: contains(lower(text), t))) AS score,
    row_number() OVER (ORDER BY 0.25 * len(list_filter(['the', 'tion', 'secret', 'license', 'of'], lambda t: contains(lower(text), t))) DESC, doc_id) AS rank FROM documents)
WHERE rank <= 100""")
def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", retrieval.lexical_score(F.lit("The tion SECRET license of, the a"), F.col("text")).alias("score"))
    best = docs.orderBy(F.col("score").desc(), "doc_id").limit(100)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")).cast("int"))


@query("""
WITH d AS (SELECT doc_id, lang, source, quality FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT doc_id, 0 AS branch FROM d WHERE lang = 'en' AND source IN ('src1', 'src2') AND quality = 1
  UNION ALL SELECT doc_id, 1 FROM d WHERE lang = 'en' AND source IN ('src1', 'src2') UNION ALL SELECT doc_id, 2 FROM d WHERE lang = 'en')
SELECT doc_id, branch, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY doc_id) AS position FROM b) WHERE position <= 60""")
def filter_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", "source", "quality")
    base = {"lang": "en", "source": ["src1", "src2"]}
    steps = [retrieval.conjunction(base | {"quality": 1}), retrieval.conjunction(base), retrieval.conjunction({"lang": "en"})]
    return retrieval.ladder(rows, steps, 60, ["doc_id"]).select("doc_id", "branch", F.col("position").cast("int"))


def _types_sql(column: str) -> str:
    case = "CASE"
    for needles, kinds in intent.DOCUMENT_TYPES:
        case += " WHEN " + " OR ".join(f"contains(lower({column}), '{n}')" for n in needles) + f" THEN '{','.join(kinds)}'"
    return case + " ELSE '' END"


@query(f"SELECT doc_id, {_types_sql('text')} AS types, CASE WHEN {' OR '.join(f'''contains(lower(text), '{n}')''' for n in intent.SOURCE_NEEDLES)} THEN 'sources' ELSE '' END AS collection, ({' OR '.join(f'''contains(lower(text), '{n}')''' for n in intent.GRADUATION_NEEDLES)}) AS graduation FROM documents")
def keyword_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(intent.document_types(c), ",").alias("types"), intent.source_collection(c).alias("collection"), intent.is_graduation(c).alias("graduation"))


@query(r"""
WITH q AS (SELECT doc_id, 'cs ' || (100 + doc_id % 900) || ' and EE-' || (200 + doc_id % 7) || 'a CS' || (100 + doc_id % 900) || ' in ' || (2000 + doc_id % 30) || '0' || (1 + doc_id % 3) || ' or spring 2024-2025' AS q FROM documents)
SELECT doc_id, 'CS ' || (100 + doc_id % 900) || ',' || 'EE ' || (200 + doc_id % 7) || 'A' AS courses,
  CASE WHEN (2000 + doc_id % 30) || '0' || (1 + doc_id % 3) = '202402' THEN '202402' ELSE (2000 + doc_id % 30) || '0' || (1 + doc_id % 3) || ',202402' END AS terms, 'CS,EE' AS programs FROM q""")
def extract_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    course = text(F.lit(100) + i % 900)
    q = F.concat(F.lit("cs "), course, F.lit(" and EE-"), text(F.lit(200) + i % 7), F.lit("a CS"), course, F.lit(" in "), text(F.lit(2000) + i % 30), F.lit("0"), text(F.lit(1) + i % 3), F.lit(" or spring 2024-2025"))
    rows = table(spark, sf_dir, "documents").select("doc_id", q.alias("q"))
    return rows.select("doc_id", F.array_join(intent.course_ids(F.col("q")), ",").alias("courses"), F.array_join(intent.term_codes(F.col("q")), ",").alias("terms"), F.array_join(intent.programs(F.col("q")), ",").alias("programs"))


@query("""
WITH hints AS (SELECT unnest([5, 17, 3, 999999, 42, 8]) AS part, unnest([0, 1, 2, 3, 4, 5]) AS pos),
sched AS (SELECT l_partkey, count(*) AS sections FROM lineitem GROUP BY l_partkey),
taken AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7)
SELECT CAST(pos AS INTEGER) AS pos, CAST(part AS BIGINT) AS part, p_name AS title, sections,
  CASE WHEN t.l_partkey IS NOT NULL THEN 'already_taken_do_not_recommend' ELSE 'eligible_candidate' END AS status
FROM hints LEFT JOIN part ON part = p_partkey LEFT JOIN sched s ON part = s.l_partkey LEFT JOIN taken t ON part = t.l_partkey WHERE p_partkey IS NOT NULL OR s.l_partkey IS NOT NULL""")
def recommend_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = spark.createDataFrame(list(enumerate([5, 17, 3, 999999, 42, 8])), "pos int, part long")
    near = F.broadcast(hints)  # six literal rows
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_orderkey")
    sections = lines.join(near.select("part"), "part", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("sections"))
    mine = table(spark, sf_dir, "orders").where("o_custkey = 7").select(F.col("o_orderkey").alias("l_orderkey"))
    taken = lines.join(mine, "l_orderkey", "left_semi").select("part", F.lit(True).alias("taken")).distinct()
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("title"))
    found = hints.join(catalog, "part", "left").join(sections, "part", "left").join(taken, "part", "left").where("title is not null or sections is not null")
    return found.select("pos", "part", "title", "sections", F.when(F.col("taken"), "already_taken_do_not_recommend").otherwise("eligible_candidate").alias("status"))


@query("""
SELECT o_custkey AS user_id, p.p_brand AS subject, p.p_partkey AS course FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part p ON l_partkey = p_partkey GROUP BY ALL""")
def user_profile_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles of all customers."""
    return _profiles(spark, sf_dir, table(spark, sf_dir, "orders"))


def _profiles(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    mine = orders.select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    links = table(spark, sf_dir, "lineitem").join(mine, F.col("l_orderkey") == F.col("o_orderkey")).select("user_id", F.col("l_partkey").alias("course")).distinct()
    return links.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("course"), F.col("p_brand").alias("subject")), "course").select("user_id", "subject", "course")


@query("""
WITH batch AS (SELECT user_id, ts + INTERVAL 400 DAY AS ts, event_id, 'changed' AS event_type FROM events WHERE user_id % 5 = 0),
every AS (SELECT user_id, ts, event_id, event_type FROM events UNION ALL SELECT * FROM batch)
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM every) WHERE rn = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    new = old.where("user_id % 5 = 0").select("user_id", (F.col("ts") + F.expr("INTERVAL 400 DAY")).alias("ts"), "event_id", F.lit("changed").alias("event_type"))
    return store.upsert(old, new, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
SELECT 'orders' AS kind, o_orderkey AS id, CASE WHEN o_custkey = 7 THEN 'deleted' ELSE o_orderstatus END AS status, 1 AS n FROM orders
UNION ALL SELECT 'lines', l_orderkey, 'kept', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7) GROUP BY l_orderkey""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    parents, left = store.cascade_delete(orders, {"lines": lines}, "id", orders.where("o_custkey = 7"))
    rest = left["lines"].groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return parents.select(F.lit("orders").alias("kind"), "id", "status", F.lit(1).cast("long").alias("n")).unionByName(rest.select(F.lit("lines").alias("kind"), "id", F.lit("kept").alias("status"), "n"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY sha256(text)")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("""
WITH c AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS r FROM documents)
SELECT 0 AS position, 'Request intent' AS label, sha256('[Source: Request intent]' || chr(10) || 'intent: ders_onerisi') AS digest
UNION ALL SELECT CAST(r AS INTEGER), source, sha256('[Source: ' || source || ', page ' || doc_id || ']' || chr(10) || text) FROM c WHERE r <= 6""")
def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n", F.length("text"))
    best = docs.orderBy(F.col("n").desc(), "doc_id").limit(6).withColumn("position", F.row_number().over(Window.orderBy(F.col("n").desc(), "doc_id")))
    shown = T.with_header(F.col("text"), F.col("source"), F.col("doc_id")).alias("text")
    first = spark.createDataFrame([(1, "Request intent", "intent: ders_onerisi", None)], "position int, source string, text string, doc_id long")
    rows = answers.assemble(first.select("position", "source", shown), best.select("position", "source", shown))
    return rows.select("position", F.col("source").alias("label"), F.sha2("text", 256).alias("digest"))


@query()
def intent_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = intent.IntentModel.fit(intent.training_rows(spark))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return model.predict(asked).select("conv_id", "turn", "intent", F.round("confidence", 6).alias("confidence"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {_begins(words, True)} THEN '{name}'" for name, _, words in intent.ROUTES) + " ELSE 'diger' END AS intent FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def route_rules_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return _routed(table(spark, sf_dir, "documents"))


def _routed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", intent.route(F.col("text"), F.lit("diger"))["intent"].alias("intent"))


@query("""
SELECT c_custkey, substr(c_name, 1, 3) || '_' AS prefix, CASE WHEN c_custkey % 3 = 0 THEN 'Fall' WHEN c_custkey % 3 = 1 THEN 'Spring' ELSE 'Summer' END || ' ' || (2000 + c_custkey % 30) || '-' || (2001 + c_custkey % 30) || ' (' || CASE WHEN c_custkey % 3 = 0 THEN 'Guz' WHEN c_custkey % 3 = 1 THEN 'Bahar' ELSE 'Yaz' END || ')' AS term,
  'Monday/Wednesday' AS days, 'CS ' || (100 + c_custkey) AS course, 'number: ' || c_custkey || '.' AS body FROM customer""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    code = F.concat((F.lit(2000) + i % 30).cast("string"), F.lit("0"), (i % 3 + 1).cast("string"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.substring("c_name", 1, 3), F.lit("_")).alias("prefix"), T.term_name(code).alias("term"), T.readable_days(F.lit("M W")).alias("days"),
        T.spaced_course_id(F.concat(F.lit("cs"), (F.lit(100) + i).cast("string"))).alias("course"), T.lines(T.field("empty", F.lit("")), T.field("number", i), F.lit(" ")).alias("body"),
    )


_CURRICULUM = """
WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN 'core' WHEN p_size % 3 = 1 THEN 'area' ELSE p_brand END AS kind, 'CS ' || p_partkey AS course, p_size FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY course) AS rn, count(*) OVER (PARTITION BY kind) AS n FROM p)
SELECT '202502/CS.jsonl' AS source_path, kind AS requirement_type, CAST((rn - 1) // 70 + 1 AS BIGINT) AS part, count(*) AS course_count, sha256(
  'Record type: aggregate course list for a program requirement category.' || chr(10) || 'Program: CS (major).' || chr(10) || 'Term: 202502 - Spring 2025-2026 (Bahar).' || chr(10)
  || 'Requirement category: ' || kind || ' (' || CASE kind WHEN 'core' THEN 'core elective / cekirdek secmeli' WHEN 'area' THEN 'area elective / alan secmeli' ELSE kind END || ').' || chr(10)
  || 'This card lists ' || count(*) || ' of ' || any_value(n) || ' courses in this category.' || chr(10)
  || 'Courses: ' || string_agg(course || ' - ' || p_name || ' (SU ' || p_size || ', ECTS )', '; ' ORDER BY rn) || '.' || chr(10)
  || 'Search aliases: CS ' || kind || ' courses, CS curriculum, CS electives.' || chr(10) || 'Source data: 202502/CS.jsonl.') AS digest
FROM n GROUP BY kind, (rn - 1) // 70"""


@query(_CURRICULUM)
def curriculum_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the rows of a program file, and its list cards."""
    kind = F.when(F.col("p_size") % 3 == 0, "core").when(F.col("p_size") % 3 == 1, "area").otherwise(F.col("p_brand"))
    row = F.to_json(F.struct(F.lit("CS").alias("Major"), F.col("p_partkey").alias("Code"), F.col("p_name").alias("Course_Name"), kind.alias("EL_Type"), F.col("p_size").cast("double").alias("SU_credit")))
    lines = table(spark, sf_dir, "part").select(F.lit("202502/CS.jsonl").alias("source_path"), F.col("p_partkey").alias("line_no"), F.parse_json(row).alias("v"), F.lit("CS").alias("program"), F.lit("major").alias("program_type"), F.lit("202502").alias("term_code"))
    lists = catalog.requirement_cards(lines)[1]
    return lists.select("source_path", "requirement_type", "part", "course_count", F.sha2("text", 256).alias("digest"))


_ALIASES = [(key, [n.replace("'", "''") for n in names]) for key, (_, names) in answers.INTERESTS.items()]
_WHOLE_AREA = "CASE " + " ".join(f"WHEN plain IN ({', '.join(chr(39) + n + chr(39) for n in names)}) THEN '{key}'" for key, names in _ALIASES) + " " + " ".join(f"WHEN {_begins('|'.join(names), True, 'plain').replace('(?i)', '')} THEN '{key}'" for key, names in _ALIASES) + " END"
_WHOLE_DETAIL = f"({_begins(answers.COURSE_DETAIL)} OR ({_begins(answers.COURSE_CODE, True)} AND NOT {_begins(answers.EXPLICIT_RECOMMENDATION)} AND NOT {_begins(answers.GRADUATION_ONLY, True)}))"


@query(rf"""
SELECT doc_id, area, CASE WHEN {_begins(answers.GRADUATION)} AND NOT {_WHOLE_DETAIL} THEN 'mezuniyet_durumu' WHEN {_WHOLE_DETAIL} THEN 'ders_ayrintisi' WHEN {_begins(answers.STUDY_PLAN)} THEN 'calisma_plani'
  WHEN {_begins(answers.MAJOR)} THEN 'major_secimi' WHEN {_begins(answers.SPECIALIZATION)} THEN 'alanda_ozellesme'
  WHEN {_begins(answers.RECOMMENDATION)} OR (area IS NOT NULL AND length(plain) <= 120 AND NOT {_begins(answers.NOT_RECOMMENDATION, True, "plain")}) THEN 'ders_onerisi' ELSE 'diger' END AS intent
FROM (SELECT *, {_WHOLE_AREA} AS area FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(regexp_replace(lower(coalesce(text, '')), '^[{_S}]+|[{_S}]+$', '', 'g'), '[{_S}]+', ' ', 'g') AS plain FROM documents))""")
def resolve_intent_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return _resolved(table(spark, sf_dir, "documents"))


def _resolved(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", answers.interest(F.col("text")).alias("area"), answers.resolve(F.col("text"), F.lit("diger")).alias("intent"))


_QUESTION = "required CS courses with the secret of license"


@query(f"""
WITH probe AS (SELECT embedding FROM embeddings WHERE vec_id = 3),
c AS (SELECT d.doc_id, text, source, CASE WHEN lang = 'en' THEN 'program_requirement' WHEN lang = 'de' THEN 'program_requirement_list' ELSE 'other' END AS kind, CASE WHEN d.doc_id % 5 < 3 THEN 'CS' ELSE 'EE' END AS program,
  CASE WHEN d.doc_id % 3 = 0 THEN 'required' ELSE 'core' END AS requirement, lang = 'de' AS aggregate, list_distance(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(probe.embedding, lambda x: CAST(x AS DOUBLE))) AS d
  FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id LEFT JOIN probe ON true),
s AS (SELECT *, 0 AS branch FROM c WHERE kind <> 'other' AND program = 'CS' AND requirement = 'required' AND aggregate UNION ALL SELECT *, 1 FROM c WHERE kind <> 'other' AND program = 'CS' AND requirement = 'required'),
hit AS (SELECT * FROM (SELECT *, 0 AS way, row_number() OVER (PARTITION BY branch ORDER BY doc_id) AS position FROM s WHERE text <> '') WHERE position <= 60
  UNION ALL SELECT * FROM (SELECT *, 1 AS way, row_number() OVER (PARTITION BY branch ORDER BY d, doc_id) AS position FROM s WHERE d IS NOT NULL) WHERE position <= 20),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY branch, way, position) AS rn FROM hit),
scored AS (SELECT *, 10 + CASE WHEN aggregate THEN 1 ELSE 0 END + 0.25 * len(list_filter(['required', 'cs', 'courses', 'with', 'the', 'secret', 'of', 'license'], lambda t: contains(lower(text), t))) AS score FROM one WHERE rn = 1)
SELECT doc_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, branch, way, position) AS rank FROM scored) WHERE rank <= 20""")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with vectors where there are any; the question names a program and a requirement type."""
    vectors = table(spark, sf_dir, "embeddings")
    probe = vectors.where("vec_id = 3").select("embedding").first().embedding
    kind = F.when(F.col("lang") == "en", "program_requirement").when(F.col("lang") == "de", "program_requirement_list").otherwise("other")
    docs = table(spark, sf_dir, "documents").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    chunks = docs.select(
        "doc_id", F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("chunk_id"), "text", "embedding", "source", kind.alias("document_type"), F.when(F.col("doc_id") % 5 < 3, "CS").otherwise("EE").alias("program"),
        F.when(F.col("doc_id") % 3 == 0, "required").otherwise("core").alias("requirement_type"), (F.col("lang") == "de").alias("aggregate"),
    )
    return retrieve.retrieve(chunks, _QUESTION, list(probe), 20).select("doc_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int"))
