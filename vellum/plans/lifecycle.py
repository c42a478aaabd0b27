"""Sources, jobs, chat batches, reviews, exams and chunks as keyed tables of hash buckets below one shared folder.

A change rewrites the buckets of the keys that it touches, as the next version of its table; see ``vellum.operators.buckets``. An
executor lost meanwhile repeats its tasks, and a failed write leaves the old version current.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.functions import text as T
from vellum.operators import buckets, cache, chunking, retrieval, store
from vellum.plans import catalog, courses
from vellum.sources import documents
from vellum.sources.documents import json_lines
from vellum.sources.shared import keep

_STAMPS = "updatedAt timestamp, createdAt timestamp"
SCHEMAS = {
    "sources": f"sourceId string, type string, fileName string, storageKey string, contentHash string, status string, createdBy string, chunksCreated long, lastIndexedAt timestamp, deletedAt timestamp, {_STAMPS}",
    "jobs": f"jobId string, sourceId string, status string, chunksCreated long, error string, startedAt timestamp, finishedAt timestamp, {_STAMPS}",
    "batches": f"batchId string, sourceId string, type string, status string, storageKey string, fileName string, contentHash string, uploadedBy string, messageCount long, preview array<string>, approvedBy string, approvedAt timestamp, chunksCreated long, {_STAMPS}",
    "reviews": f"reviewId string, sourceId string, uploadBatchId string, text string, author string, messageDate string, status string, {_STAMPS}",
    "exams": f"examId string, sourceId string, courseCode string, year string, semester string, examType string, fileName string, storageKey string, contentHash string, status string, chunksCreated long, {_STAMPS}",
    "chunks": "chunk_id string, sourceId string, chunkIndex long, text string, documentType string, document_type string, source string, location string, page int, slide int, section string, source_collection string, source_path string, module string, embedding array<double>",
}
SCHEMAS["courses"] = ", ".join(f"{c} string" for c in (*courses.TEXTS, *courses.CREDITS))
SCHEMAS["user_courses"] = "linkId string, username string, code string"
KEYS = {"user_courses": "linkId", "courses": "code", "sources": "sourceId", "jobs": "jobId", "batches": "batchId", "reviews": "reviewId", "exams": "examId", "chunks": "chunk_id"}
PREVIEW = 8


def now() -> datetime:
    return datetime.now(UTC)


def summaries(messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, messageCount, preview (the first texts) and text (all, a line each) of the exports that messages (keys, index from 0, text) come from.

    An export's texts meet in one row, which suits exports of megabytes; the preview alone is bounded, so it travels in partial aggregates.
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"])
    said = F.struct("index", "text")
    return messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("messageCount"), ordered(F.when(F.col("index") < PREVIEW, said)).alias("preview"), F.array_join(ordered(said), "\n").alias("text"))


def review_rows(messages: DataFrame) -> DataFrame:
    """Reviews of approved messages (sourceId, uploadBatchId, index, text, author, date), told by source, index and text."""
    named = T.content_hash(F.concat_ws(":", "sourceId", F.col("index").cast("string"), "text"))
    return messages.select(F.concat(F.lit("review:"), F.substring(named, 1, 24)).alias("reviewId"), "sourceId", "uploadBatchId", "text", "author", F.col("date").alias("messageDate"), F.lit("approved").alias("status"))


class Store:
    """The tables below ``root``. One writer at a time a table; a second one's change is refused."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> buckets.Buckets:
        return buckets.Buckets(self.spark, f"{self.root}/{name}", SCHEMAS[name], KEYS[name], ("createdAt",) if "createdAt" in SCHEMAS[name] else ())

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def vectors(self) -> cache.Vectors:
        """The vectors of chunks and questions, each computed once."""
        return cache.Vectors(self.spark, f"{self.root}/embeddings")

    def nearest(self, question: str, k: int = 20) -> DataFrame:
        """The ``k`` chunks nearest to a question, with distance and rank."""
        probe = self.vectors().add(self.spark.createDataFrame([("question", question)], "probe_id string, text string")).select("probe_id", F.col("embedding").alias("probe"))
        points = self.read("chunks").where("embedding is not null").withColumnRenamed("chunk_id", "vec_id")
        return retrieval.dense_topk(points, probe.where("probe is not null"), k).drop("probe_id").withColumnRenamed("vec_id", "chunk_id")

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows by key, into the buckets of their keys. A column that ``rows`` lack keeps its value, as does createdAt; chunks are replaced whole, and of equal ids the first one counts. Chunks get their vectors here."""
        if name == "chunks":
            rows = self.vectors().add(store.first_per_key(rows, [KEYS[name]], ["sourceId", "chunkIndex"]))
        self.table(name).merge(rows, whole=name == "chunks")
        if name == "chunks":
            self.table(name).grow()

    def put(self, name: str, **values: object) -> None:
        """One row, updated at this moment."""
        at = now()
        row = values | {"updatedAt": at, "createdAt": at}
        fields = [f for f in self.read(name).schema.fields if f.name in row]
        self.upsert(name, self.spark.createDataFrame([tuple(row[f.name] for f in fields)], StructType(fields)))

    # Jobs.

    def start_job(self, source_id: str) -> str:
        at = now()
        job_id = f"{source_id}:{at:%Y%m%d%H%M%S%f}"
        self.put("jobs", jobId=job_id, sourceId=source_id, status="processing", chunksCreated=0, error="", startedAt=at)
        self.put("sources", sourceId=source_id, status="processing")
        return job_id

    def finish_job(self, job_id: str, source_id: str, status: str, chunks: int, error: str = "") -> None:
        at = now()
        self.put("jobs", jobId=job_id, status=status, chunksCreated=chunks, error=error, finishedAt=at)
        self.put("sources", sourceId=source_id, status=status, chunksCreated=chunks, **({"lastIndexedAt": at} if status == "indexed" else {}))

    # Ingestion.

    def _add(self, records: DataFrame, collection: str = "") -> None:
        """Chunks of records (text, source_hash, document_type, page, slide, section, ord, source)."""
        told = [F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in ("source_path", "module")]
        made = chunking.chunks(records).select(
            F.col("chunkId").alias("chunk_id"), "sourceId", "chunkIndex", F.col("chunk").alias("text"), T.document_type(F.col("document_type")).alias("documentType"), "document_type", "source", "location", "page", "slide", "section",
            F.nullif(F.lit(collection), F.lit("")).alias("source_collection"), *told,
        )
        self.upsert("chunks", made)

    def ingest_files(self, root: str, document_type: str, created_by: str = "system", excluded: set[str] = frozenset()) -> int:
        """All supported files below a folder, by one distributed job; sources and jobs get a row a file. On an error they are marked failed and it is raised."""
        name = F.url_decode(F.replace(F.regexp_extract("path", "([^/]*)$", 1), F.lit("+"), F.lit("%2B")))
        return self._ingest_found(documents.files(self.spark, root, excluded=excluded).withColumn("fileName", name), document_type, created_by)

    def _ingest_found(self, found: DataFrame, document_type: str, created_by: str) -> int:
        """Files (path, suffix, content, fileName) as sources."""
        kind = self.spark.range(1).select(T.document_type(F.lit(document_type)).alias("k")).first().k
        digest = F.sha2("content", 256)
        known = found.select("path", digest.alias("contentHash"), "fileName")
        known = store.first_per_key(known.withColumn("sourceId", T.source_id(F.lit(kind), F.col("contentHash"))), ["sourceId"], ["path"])
        at = F.lit(now())
        stamp = f"{now():%Y%m%d%H%M%S%f}"

        def mark(status: str, n: DataFrame | None = None, error: str = "") -> None:
            rows = known if n is None else known.join(n, "sourceId", "left")
            count = F.lit(0).cast("long") if n is None else F.coalesce("n", F.lit(0)).cast("long")
            base = rows.withColumns({"status": F.lit(status), "updatedAt": at, "createdAt": at, "chunksCreated": count})
            shown = base.select("sourceId", F.lit(kind).alias("type"), "fileName", F.col("path").alias("storageKey"), "contentHash", "status", F.lit(created_by).alias("createdBy"), "chunksCreated", "updatedAt", "createdAt", *([F.lit(now()).alias("lastIndexedAt")] if status == "indexed" else []))
            self.upsert("sources", shown)
            done = [F.lit(now()).alias("finishedAt")] if status != "processing" else []
            self.upsert("jobs", base.select(F.concat("sourceId", F.lit(":" + stamp)).alias("jobId"), "sourceId", "status", "chunksCreated", F.lit(error).alias("error"), at.alias("startedAt"), *done, "updatedAt", "createdAt"))

        mark("processing")
        try:
            # A file under two names is one source, and read once.
            single = found.drop("fileName").dropDuplicates(["path"]).join(known.select("path", F.col("contentHash").alias("source_hash"), F.col("fileName").alias("source")), "path")
            records = documents.load(single).join(single.select("path", "source_hash", "source"), "path").withColumn("document_type", F.lit(document_type))
            self._add(records)
        except Exception as error:
            mark("failed", error=str(error)[:2000])
            raise
        counted = self.read("chunks").join(known.select("sourceId"), "sourceId", "left_semi").groupBy("sourceId").agg(F.count(F.lit(1)).alias("n"))
        mark("indexed", counted)
        return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n

    def ingest_text(self, text: str, source_name: str, document_type: str, source_id: str, storage_key: str = "", created_by: str = "system") -> int:
        """One text as one source of the given id (``type:hash``)."""
        return self._ingest(self.spark.createDataFrame([(text,)], "text string"), source_name, source_id, storage_key, created_by)

    def _ingest(self, text: DataFrame, source_name: str, source_id: str, storage_key: str, created_by: str) -> int:
        """The one row of ``text`` as one source; it stays a DataFrame."""
        kind, short = source_id.split(":", 1)
        digest = text.select(F.sha2("text", 256).alias("d")).first().d
        self.put("sources", sourceId=source_id, type=kind, fileName=source_name, storageKey=storage_key, contentHash=digest, status="uploaded", createdBy=created_by)
        job = self.start_job(source_id)
        try:
            records = text.withColumns({"source_hash": F.lit(short), "document_type": F.lit(kind), "source": F.lit(source_name)})
            none = {"page": F.lit(None).cast("int"), "slide": F.lit(None).cast("int"), "section": F.lit(None).cast("string"), "ord": F.lit(0)}
            self._add(records.withColumns(none))
            n = self.read("chunks").where(F.col("sourceId") == source_id).count()
        except Exception as error:
            self.finish_job(job, source_id, "failed", 0, str(error)[:2000])
            raise
        self.finish_job(job, source_id, "indexed", n)
        return n

    def index_folder(self, root: str) -> int:
        """A folder's files as the collection ``sources``, each section a source of its own, told by paths below the folder; the first folder of a path is its module. Nothing if the collection has chunks."""
        if not self.read("chunks").where("source_collection = 'sources'").limit(1).isEmpty():
            return 0
        found = documents.files(self.spark, root)
        below = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"^.*?/{re.escape(re.sub(r'^[A-Za-z0-9+.-]+://[^/]*', '', root).strip('/'))}/+", "")
        module = F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise("sources")
        records = documents.load(found).withColumns({"source_hash": F.lit(None).cast("string"), "document_type": F.lit("course"), "source": below, "source_path": below, "module": module})
        self._add(records, "sources")
        return self.read("chunks").where("source_collection = 'sources'").count()

    def ingest_catalog(self, root: str) -> int:
        """The catalog's cards as chunks, and a source a file."""
        cards = catalog.rekeyed(catalog.catalog(self.spark, root))
        self.upsert("chunks", cards.select("chunk_id", "sourceId", "chunkIndex", "text", "documentType", "document_type", "source"))
        at = F.lit(now())
        files = cards.groupBy("sourceId", "source_path").agg(F.count(F.lit(1)).alias("chunksCreated"))
        self.upsert("sources", files.select("sourceId", F.lit("course").alias("type"), F.col("source_path").alias("fileName"), F.lit(root).alias("storageKey"), T.content_hash(F.col("source_path")).alias("contentHash"), F.lit("indexed").alias("status"), F.lit("bulk-script").alias("createdBy"), "chunksCreated", at.alias("lastIndexedAt"), at.alias("updatedAt"), at.alias("createdAt")))
        return files.agg(F.coalesce(F.sum("chunksCreated"), F.lit(0)).alias("n")).first().n

    def seed_courses(self, root: str) -> int:
        """Courses from the pages of a catalog folder, or a few built-in ones without them; 0 if there are courses already."""
        if not self.read("courses").limit(1).isEmpty():
            return 0
        path, fs = self.table("courses")._fs(f"{root.rstrip('/')}/all_coursepage_info.jsonl")
        pages = json_lines(self.spark, str(path.toString())) if fs.exists(path) else None
        found = courses.fallback(self.spark) if pages is None else courses.seeds(pages.select("line_no", F.parse_json("line").alias("v")))
        return self.table("courses").merge(found.where("code <> '' and title <> ''"))

    def set_courses(self, username: str, asked: DataFrame) -> int:
        """A user's courses, all replaced by those of ``asked`` (code) that exist; their number."""
        known = store.requested(asked, self.read("courses"), "code")
        rows = known.select(F.concat_ws("\x1f", F.lit(username), "code").alias("linkId"), F.lit(username).alias("username"), "code")
        return self.table("user_courses").replace(F.col("username") == username, rows)

    # Uploads.

    def save_raw(self, files: DataFrame) -> DataFrame:
        """``files`` (name, content) with contentHash and storageKey; contents that aren't stored yet are, once each.

        Contents are rows of an append-only table, told by their SHA-256. A retried task's file is committed once, and equal contents, of one upload or of two, are one row.
        """
        named = files.select("name", "content", F.sha2("content", 256).alias("contentHash"))
        path, fs = self.table("sources")._fs(f"{self.root}/files")
        stored = self.spark.read.schema("contentHash string").parquet(f"{self.root}/files") if fs.exists(path) else self.spark.createDataFrame([], "contentHash string")
        fresh = named.join(stored, "contentHash", "left_anti").groupBy("contentHash").agg(F.first("content").alias("content"))
        fresh.write.mode("append").parquet(f"{self.root}/files")
        return named.withColumn("storageKey", F.concat(F.lit("files/"), "contentHash"))

    def raw(self, *keys: str) -> DataFrame:
        """storageKey and content of stored files."""
        wanted = [k.removeprefix("files/") for k in keys]
        held = self.spark.read.schema("contentHash string, content binary").parquet(f"{self.root}/files")
        return held.where(F.col("contentHash").isin(wanted)).select(F.concat(F.lit("files/"), "contentHash").alias("storageKey"), "content")

    def upload(self, files: DataFrame, document_type: str = "course", created_by: str = "system") -> tuple[int, DataFrame]:
        """Saves and ingests uploaded files (name, content) of supported kinds: the number of chunks, and each file's name, whether it was accepted, and its storageKey."""
        suffix = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1))
        judged = files.withColumn("suffix", suffix).withColumn("accepted", F.col("suffix").isin(*documents.SUFFIXES))
        kept, drop = keep(self.save_raw(judged.where("accepted")))
        n = 0
        if not kept.limit(1).isEmpty():
            n = self._ingest_found(kept.select(F.col("storageKey").alias("path"), F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1)).alias("suffix"), "content", T.safe_filename(F.col("name")).alias("fileName")), document_type, created_by)
        report = kept.select("name", F.lit(True).alias("accepted"), "storageKey").union(judged.where(~F.col("accepted")).select("name", "accepted", F.lit(None).cast("string")))
        told, _ = keep(report)
        drop()
        return n, told

    # Chat exports: pending, then approved or rejected.

    def _messages(self, path: str) -> tuple[DataFrame, dict]:
        """Messages of one export, and its facts."""
        found = self.spark.read.format("binaryFile").load(path).withColumn("suffix", F.lit(".txt"))
        facts = found.select(F.sha2("content", 256).alias("digest"), F.regexp_extract("path", "([^/]*)$", 1).alias("name")).first().asDict()
        return documents.chat(documents.decoded(found), ["path"]), facts

    def create_batch(self, path: str, uploaded_by: str = "admin") -> dict:
        """A pending batch of a chat export that lies in the shared folder; count and first messages for review."""
        messages, facts = self._messages(path)
        batch, source = f"whatsapp:{facts['digest'][:24]}", f"review:{facts['digest'][:24]}"
        told = summaries(messages, []).first()
        n, preview = told.messageCount, told.preview
        self.put("sources", sourceId=source, type="review", fileName=facts["name"], storageKey=path, contentHash=facts["digest"], status="pending", createdBy=uploaded_by)
        self.put("batches", batchId=batch, sourceId=source, type="whatsapp", status="pending", storageKey=path, fileName=facts["name"], contentHash=facts["digest"], uploadedBy=uploaded_by, messageCount=n, preview=preview)
        return {"batchId": batch, "sourceId": source, "status": "pending", "messageCount": n, "preview": preview}

    def confirm_batch(self, batch_id: str, approved: bool = True, approved_by: str = "admin") -> dict:
        """Approves (reviews and chunks are stored) or rejects a batch. Both may be repeated."""
        batch = self.read("batches").where(F.col("batchId") == batch_id).first()
        if batch is None:
            raise ValueError(f"Upload batch not found: {batch_id}")
        known = {"batchId": batch_id, "sourceId": batch.sourceId}
        if not approved:
            self.put("batches", batchId=batch_id, status="rejected", approvedBy=approved_by)
            self.put("sources", sourceId=batch.sourceId, status="rejected")
            return known | {"status": "rejected"}
        messages, _ = self._messages(batch.storageKey)
        at = F.lit(now())
        named = messages.withColumns({"sourceId": F.lit(batch.sourceId), "uploadBatchId": F.lit(batch_id)})
        self.upsert("reviews", review_rows(named).withColumns({"updatedAt": at, "createdAt": at}))
        n = self._ingest(summaries(messages, []).select("text"), batch.fileName, batch.sourceId, batch.storageKey, approved_by)
        self.put("batches", batchId=batch_id, status="indexed", approvedBy=approved_by, approvedAt=now(), chunksCreated=n)
        return known | {"status": "indexed", "chunks": n}

    def ingest_exam(self, path: str, course_code: str = "", year: str = "", semester: str = "", exam_type: str = "", uploaded_by: str = "admin") -> dict:
        """An exam file: its chunks, and a row that describes it."""
        n = self.ingest_files(path, "exam", uploaded_by)
        facts = self.spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("digest"), F.regexp_extract("path", "([^/]*)$", 1).alias("name")).first()
        exam, source = f"exam:{facts.digest[:24]}", f"exam:{facts.digest[:24]}"
        self.put("exams", examId=exam, sourceId=source, courseCode=course_code.strip().upper(), year=year.strip(), semester=semester.strip(), examType=exam_type.strip().lower(), fileName=facts.name, storageKey=path, contentHash=facts.digest, status="indexed", chunksCreated=n)
        return {"examId": exam, "sourceId": source, "status": "indexed", "chunks": n}

    def delete_source(self, source_id: str, hard: bool = False) -> dict:
        """Marks a source deleted, or removes it; its chunks go, and its reviews, exams and batches are marked."""
        mine = F.col("sourceId") == source_id
        if self.read("sources").where(mine).limit(1).isEmpty():
            raise ValueError(f"Source not found: {source_id}")
        if hard:
            self.table("sources").remove(mine)
        else:
            self.table("sources").update(mine, status="deleted", updatedAt=now(), deletedAt=now())
        report = {"sourceId": source_id, "deletedChunks": self.table("chunks").remove(mine), "hard": hard}
        for name in ("reviews", "exams", "batches"):
            report[name] = self.table(name).update(mine, status="deleted", updatedAt=now())
        return report
