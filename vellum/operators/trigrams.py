"""Substring search, whatever the case, by an index of trigrams.

Each distinct run of three characters of a row's lower-case text is a posting (gram, id). Postings lie in folders by the gram's hash and are sorted by gram, so a search reads the folders and row groups of its term's
grams alone. Rows that hold all grams of a term are candidates; texts lie in folders by the id's hash, only those of candidates are read, and ``contains`` verifies them, so results equal those of a scan.

A term of fewer than three characters, or whose rarest gram more than a ``COMMON``-th of all rows hold, is searched by a scan. Null texts are found by no term. Ids are unique and not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, FOLDERS, COMMON = 3, 64, 4


def grams(low: Column) -> Column:
    """The distinct trigrams of a lower-case text."""
    def of(chars: Column) -> Column:
        starts = F.when(F.size(chars) >= GRAM, F.sequence(F.lit(0), F.size(chars) - GRAM)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.concat(*[F.get(chars, i + j) for j in range(GRAM)])))

    return F.element_at(F.transform(F.array(F.split(low, "")), of), 1)  # the text is split once


class Index:
    """The index below ``path`` of rows (id, text)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _of(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(FOLDERS)).cast("int")

    def build(self, rows: DataFrame) -> "Index":
        """Writes texts, postings and the number of rows of each gram."""
        texts = rows.select("id", "text", self._of(F.col("id")).alias("folder"))
        texts.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/texts")
        stored = self.spark.read.parquet(f"{self.path}/texts")
        posted = stored.select("id", F.explode(grams(F.lower("text"))).alias("gram")).withColumn("folder", self._of(F.col("gram")))
        # A gram that a third of all rows hold is split by range of id.
        dealt = posted.repartitionByRange("folder", "gram", "id").sortWithinPartitions("folder", "gram", "id")
        dealt.write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/postings")
        held = self.spark.read.parquet(f"{self.path}/postings").groupBy("folder", "gram").agg(F.count(F.lit(1)).alias("n"))
        held.repartition("folder").sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/frequencies")
        return self

    def _wanted(self, terms: list[str]) -> DataFrame:
        """term, gram, folder and number of each term's grams."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").withColumn("all", grams(F.lower("term")))
        return asked.select("term", F.size("all").alias("number"), F.explode("all").alias("gram")).withColumn("folder", self._of(F.col("gram")))

    def _read(self, table: str, wanted: list[tuple[int, str]]) -> DataFrame:
        """Rows of a table of grams whose gram is wanted."""
        found = self.spark.read.parquet(f"{self.path}/{table}")
        return found.where(F.col("folder").isin(sorted({f for f, _ in wanted})) & F.col("gram").isin(sorted({g for _, g in wanted})))

    def search(self, *terms: str, report: dict | None = None) -> DataFrame:
        """term, id and text of all rows with a term (as given) in their text. ``report`` takes the number of texts that were looked at (read), of all (rows), and the terms that were scanned for."""
        wanted = self._wanted(sorted(set(terms)))
        asked = wanted.select("term", "gram", "folder").collect()  # a row a letter
        rows = self.spark.read.parquet(f"{self.path}/texts")
        total = rows.count()  # from the files' footers
        known = {r.gram: r.n for r in self._read("frequencies", [(r.folder, r.gram) for r in asked]).select("gram", "n").collect()}
        rarest = {t: min((known.get(r.gram, 0) for r in asked if r.term == t), default=total + 1) for t in set(terms)}
        scanned = sorted(t for t, n in rarest.items() if n * COMMON > total)
        sought = [t for t in rarest if t not in scanned and rarest[t]]
        found = None
        if sought:
            mine = [r for r in asked if r.term in sought]
            postings = self._read("postings", [(r.folder, r.gram) for r in mine]).select("id", "gram")
            met = postings.join(F.broadcast(wanted.where(F.col("term").isin(sought)).select("term", "number", "gram")), "gram")
            candidates = met.groupBy("term", "id").agg(F.count(F.lit(1)).alias("n"), F.first("number").alias("number")).where("n = number").select("term", "id")
            folders = [r.folder for r in candidates.select(self._of(F.col("id")).alias("folder")).distinct().collect()]  # at most FOLDERS
            near = rows.where(F.col("folder").isin(folders)) if folders else rows.limit(0)
            found = near.join(candidates, "id").select("term", "id", "text")
        if scanned:
            every = rows.select(F.explode(F.array(*[F.lit(t) for t in scanned])).alias("term"), "id", "text")
            found = every if found is None else found.unionByName(every)
        if report is not None:
            report |= {"read": 0 if found is None else found.count(), "rows": total, "scanned": scanned}
        if found is None:
            return rows.limit(0).select(F.lit("").alias("term"), "id", "text")
        return found.where(F.contains(F.lower("text"), F.lower("term")))


def scores(index: Index, terms: list[str], weight: float = 0.25, report: dict | None = None) -> DataFrame:
    """id and score, ``weight`` a term, of all rows with any of the terms (lower-case)."""
    return index.search(*terms, report=report).groupBy("id").agg((F.count(F.lit(1)) * F.lit(weight)).alias("score"))
