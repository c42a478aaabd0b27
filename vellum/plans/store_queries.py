"""Queries of the keyed store, with their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import embed
from vellum.operators.buckets import Buckets
from vellum.operators.cache import Vectors
from vellum.plans.queries import table
from vellum.sources.documents import json_lines
from vellum.sources.shared import keep, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_ORDERS = "id long, owner long, status string, price double, createdAt string"


def _orders(spark: SparkSession, sf_dir: str) -> tuple[Buckets, DataFrame]:
    """An empty store, and all orders as its first rows."""
    held = Buckets(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", _ORDERS, "id", ("createdAt",), 8)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit("v0").alias("createdAt"))
    return held, rows


def _told(held: Buckets) -> DataFrame:
    """What the store holds, as a table of its own; the store goes."""
    rows, _ = keep(held.read())
    path, fs = held._fs(held.path)
    fs.delete(path, True)
    return rows


@query("""
WITH first AS (SELECT o_orderkey AS id, o_custkey AS owner, o_totalprice AS price, o_orderstatus AS status FROM orders),
old AS (
  SELECT id, owner, price, 'v0' AS createdAt,
    CASE WHEN owner % 10 > 0 OR id % 3 = 0 THEN 'merge ' || CASE WHEN owner % 10 > 0 AND id % 3 <> 0 THEN owner % 10 ELSE 10 END ELSE status END AS status FROM first),
new AS (SELECT id + 100000000 * (owner % 10) AS id, owner, price, 'merge ' || (owner % 10) AS createdAt, 'new' AS status FROM first WHERE owner % 10 > 0 AND id % 4 = 0)
FROM old UNION ALL BY NAME FROM new""")
def store_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, after nine merges that update some and add some, and a tenth that updates a third."""
    held, rows = _orders(spark, sf_dir)
    held.merge(rows)
    for i in range(1, 10):
        mine = rows.where(F.col("owner") % 10 == i).withColumn("createdAt", F.lit(f"merge {i}"))
        fresh = mine.where("id % 4 = 0").withColumns({"id": F.col("id") + 100_000_000 * i, "status": F.lit("new")})
        held.merge(mine.withColumn("status", F.lit(f"merge {i}")).unionByName(fresh))
    held.merge(rows.where("id % 3 = 0").select("id", F.lit("merge 10").alias("status")))
    return _told(held)


@query("""
SELECT o_orderkey AS id, o_custkey AS owner, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE o_orderstatus END AS status, o_totalprice AS price, 'v0' AS createdAt FROM orders WHERE o_custkey % 7 NOT IN (2, 3)
UNION ALL SELECT o_orderkey + 100000000, o_custkey, 'link', NULL, 'again' FROM orders WHERE o_custkey % 7 = 3 AND o_orderkey % 2 = 0""")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders after an update-many, a removal of owners, and a replacement of owners' rows by others."""
    held, rows = _orders(spark, sf_dir)
    held.merge(rows)
    held.update(F.col("price") > 100_000, status="large")
    held.remove(F.col("owner") % 7 == 2)
    links = rows.where("owner % 7 = 3 and id % 2 = 0").select((F.col("id") + 100_000_000).alias("id"), "owner", F.lit("link").alias("status"), F.lit("again").alias("createdAt"))
    held.replace(F.col("owner") % 7 == 3, links)
    return _told(held)


@query("""
SELECT 'source' AS kind, c_custkey AS id, CASE WHEN c_custkey % 9 = 4 THEN 'deleted' ELSE 'indexed' END AS status FROM customer
UNION ALL SELECT 'chunk', o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 9 <> 4""")
def store_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources and orders as their chunks: sources are marked deleted, and their chunks go."""
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    sources = Buckets(spark, f"{root}/sources", "id long, status string", "id", buckets=4)
    sources.merge(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("indexed").alias("status")))
    chunks, rows = _orders(spark, sf_dir)
    chunks.merge(rows)
    sources.update(F.col("id") % 9 == 4, status="deleted")
    chunks.remove(F.col("owner") % 9 == 4)
    return _told(sources).select(F.lit("source").alias("kind"), "id", "status").union(_told(chunks).select(F.lit("chunk").alias("kind"), "id", "status"))


_WORDS = r"""
words AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS word FROM documents) GROUP BY ALL),
hashed AS (SELECT doc_id, n, CAST('0x' || substr(md5(word), 1 + 4 * j, 4) AS INTEGER) AS v FROM words, unnest([0, 1, 2, 3]) AS t(j)),
summed AS (SELECT doc_id, v % 64 AS dimension, sum(n * (1 - v // 64 % 2 * 2)) AS n FROM hashed GROUP BY ALL)"""


@query(f"""
WITH {_WORDS}
SELECT doc_id, sha256(string_agg(CAST(coalesce(s.n, 0) AS BIGINT), ',' ORDER BY dimension)) AS counts, round(sqrt(sum(coalesce(s.n, 0) * coalesce(s.n, 0))), 6) AS norm
FROM (SELECT DISTINCT doc_id FROM words) CROSS JOIN unnest(range(64)) AS t(dimension) LEFT JOIN summed s USING (doc_id, dimension) GROUP BY doc_id""")
def embedding_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashed counts of all documents' words, before they are scaled to unit length."""
    found = embed.counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    norm = F.sqrt(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x * x).cast("double"))
    return found.select("doc_id", F.sha2(F.array_join(F.transform("counts", lambda x: x.cast("string")), ","), 256).alias("counts"), F.round(norm, 6).alias("norm"))


@query("""
SELECT 'first' AS run, count(DISTINCT coalesce(text, '')) AS computed, count(*) AS rows FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT 'second', (SELECT count(DISTINCT coalesce(text, '')) FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM documents WHERE doc_id % 2 = 0)), count(*) FROM documents
UNION ALL SELECT 'third', 0, count(*) FROM documents""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of half the documents, of all, and of all again: how many are computed each time, and how many rows come back."""
    held, docs = Vectors(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"), table(spark, sf_dir, "documents").select("doc_id", "text")
    told = []
    for run, rows in (("first", docs.where("doc_id % 2 = 0")), ("second", docs), ("third", docs)):
        n = held.add(rows).count()
        told.append((run, held.computed, n))
    path, fs = held.table._fs(held.table.path)
    fs.delete(path, True)
    return spark.createDataFrame(told, "run string, computed long, rows long")


@query("""
WITH told AS (SELECT event_id, user_id % 4 AS part, event_type, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS n, sum(CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS blanks FROM events)
SELECT CAST(part AS INTEGER) AS part, CAST(n + blanks AS BIGINT) AS line_no, event_id, event_type FROM told""")
def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events written as four files of JSON lines, with blank lines among them, and read back with their line numbers."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    line = F.concat(F.when(F.col("event_id") % 10 == 3, "\n").otherwise(""), F.to_json(F.struct("event_id", "event_type")))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("int").alias("part"), "event_id", line.alias("value"))
    rows.repartition(4, "part").sortWithinPartitions("part", "event_id").select("value", "part").write.partitionBy("part").text(folder)
    found = json_lines(spark, folder, recursiveFileLookup="true", pathGlobFilter="*.txt")
    read = found.select(F.regexp_extract("path", "part=([0-9]+)/", 1).cast("int").alias("part"), "line_no", F.from_json("line", "event_id long, event_type string").alias("x")).select("part", "line_no", "x.event_id", "x.event_type")
    kept, _ = keep(read)
    path, fs = Buckets(spark, folder, "x long", "x")._fs(folder)
    fs.delete(path, True)
    return kept
