"""Files that arrive in a folder, chunked and upserted into the chunk table as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.chunking import chunks
from vellum.sources.documents import load


def follow(spark: SparkSession, folder: str, checkpoint: str, upsert: Callable[[DataFrame, int], None], document_type: str = "course", **options: str) -> StreamingQuery:
    """Starts the stream. ``upsert`` gets each micro-batch's chunks and its number, and must be idempotent, as a batch may come again."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    for key, value in options.items():
        source = source.option(key, value)
    found = source.load(folder).select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "content")

    def batch(rows: DataFrame, number: int) -> None:
        hashes = rows.select("path", F.sha2("content", 256).alias("source_hash"))
        records = load(rows).join(hashes, "path").withColumn("document_type", F.lit(document_type))
        upsert(chunks(records), number)

    return found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
