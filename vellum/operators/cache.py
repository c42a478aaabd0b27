"""A table of computed vectors by key: what it holds isn't computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import embed
from vellum.functions import text as T
from vellum.operators.buckets import Buckets
from vellum.sources.shared import keep

SCHEMA = "cacheKey string, vector array<double>"
#: Missing keys that may be broadcast.
SMALL = 50_000


class Vectors:
    """Vectors of texts by provider, model and content. Texts without a vector are remembered as such."""

    def __init__(self, spark: SparkSession, path: str, provider: str = embed.PROVIDER, model: str = embed.MODEL):
        self.table, self.provider, self.model, self.computed = Buckets(spark, path, SCHEMA, "cacheKey"), provider, model, 0

    def add(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with text) with ``embedding``. Texts that the table lacks are computed, once each, and added to it; ``computed`` is their number."""
        key = T.embedding_cache_key(F.lit(self.provider), F.lit(self.model), F.coalesce("text", F.lit("")))
        keyed = rows.withColumn("cacheKey", key)
        self.computed = 0
        # Keys alone tell what is missing, and only its texts meet by key.
        missing, drop = keep(keyed.select("cacheKey").distinct().join(self.table.read().select("cacheKey"), "cacheKey", "left_anti"))
        if n := missing.count():
            wanted = keyed.select("cacheKey", "text").join(F.broadcast(missing) if n <= SMALL else missing, "cacheKey", "left_semi")
            made, drop_made = keep(embed.vectors(wanted.groupBy("cacheKey").agg(F.first("text").alias("text")), "cacheKey"))
            self.computed = self.table.merge(missing.join(made, "cacheKey", "left"))
            drop_made()
        drop()
        return keyed.join(self.table.read().withColumnRenamed("vector", "embedding"), "cacheKey", "left").drop("cacheKey")
