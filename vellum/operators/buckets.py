"""A keyed table in hash buckets, of which a change rewrites only those that it touches.

Rows lie in the bucket of their key's hash, and each bucket is a folder of Parquet below ``data``. A manifest, a small JSON file, names the folders that make a version. A change reads the touched
buckets, writes them anew beside the old ones, and then puts the next manifest in place by a rename, which fails if another writer was first. Until then readers see the old
version, whose folders stay for ``KEPT`` versions; so a lost executor or driver leaves a whole table. Keys are unique: a merge with a repeated or null key is refused.

Buckets double once they hold more than ``MOST`` rows on average, so a bucket stays a task's work. The driver reads one row a bucket.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

KEPT, BUCKETS, MOST = 2, 16, 1_000_000


class DuplicateKey(ValueError):
    """A merge would store two rows of one key."""


class Conflict(RuntimeError):
    """Another writer has stored this version."""


class Buckets:
    """The table at ``path``, with ``schema`` and its unique ``key``; ``insert_only`` columns keep their first value."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, insert_only: tuple[str, ...] = (), buckets: int | None = None):
        self.spark, self.path, self.key, self.insert_only, self.first = spark, path.rstrip("/"), key, insert_only, buckets or BUCKETS
        self.schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    # The manifest.

    def _fs(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made, made.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(path):
            return []
        return sorted(int(name) for name in (s.getPath().getName() for s in fs.listStatus(path)) if name.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets and folders (bucket to folder) of a version, the last if none is named."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": self.first, "folders": {}}
        path, fs = self._fs(f"{self.path}/manifest/{version or known[-1]}")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return found | {"folders": {int(k): v for k, v in found["folders"].items()}}

    def _commit(self, old: dict, buckets: int, folders: dict[int, str]) -> None:
        """The next version, and the end of what no kept version names."""
        made = {"version": old["version"] + 1, "buckets": buckets, "folders": folders}
        draft, fs = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        final = self._fs(f"{self.path}/manifest/{made['version']}")[0]
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {made['version']} of {self.path} exists")
        known = self.versions()
        needed = {f for v in known[-KEPT:] for f in self.manifest(v)["folders"].values()}
        for v in known[:-KEPT]:
            for folder in set(self.manifest(v)["folders"].values()) - needed:
                fs.delete(self._fs(f"{self.path}/{folder}")[0], True)
            fs.delete(self._fs(f"{self.path}/manifest/{v}")[0], False)

    # Reading.

    def _bucket(self, buckets: int, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64((F.col(self.key) if key is None else key).cast(self.schema[self.key].dataType)), F.lit(buckets)).cast("int")

    def _load(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def read(self, version: int | None = None) -> DataFrame:
        return self._load(list(self.manifest(version)["folders"].values()))

    def get(self, *keys: object) -> DataFrame:
        """Rows of the keys, from their buckets alone."""
        now = self.manifest()
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        touched = {r.b for r in asked.select(self._bucket(now["buckets"]).alias("b")).collect()}
        return self._load([f for b, f in now["folders"].items() if b in touched]).join(F.broadcast(asked), self.key, "left_semi")

    # Changes.

    def _store(self, old: dict, rows: DataFrame, touched: set[int] | None, buckets: int | None = None) -> None:
        """``rows`` instead of those of the touched buckets (of all, if None)."""
        number = buckets or old["buckets"]
        made = f"data/{uuid.uuid4().hex}"
        dealt = rows.select(*self.schema.names, self._bucket(number).alias("_bucket"))
        dealt.repartition(number if touched is None else max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{made}")
        path, fs = self._fs(f"{self.path}/{made}")
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        fresh = {int(n.split("=")[1]): f"{made}/{n}" for n in names if "=" in n}
        kept = {} if touched is None else {b: f for b, f in old["folders"].items() if b not in touched}
        try:
            self._commit(old, number, kept | fresh)
        except Conflict:
            fs.delete(path, True)
            raise

    def _of(self, old: dict, touched: set[int]) -> DataFrame:
        return self._load([f for b, f in old["folders"].items() if b in touched])

    def merge(self, rows: DataFrame, whole: bool = False) -> int:
        """Rows by key: new ones are added, others updated; the number of rows. Columns that ``rows`` lack keep their value, or become null with ``whole``."""
        old = self.manifest()
        counted = rows.groupBy(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)).agg(F.count(F.lit(1)).alias("n"))
        told = counted.groupBy(self._bucket(old["buckets"]).alias("b")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.when(F.col(self.key).isNull(), 1)).alias("nulls")).collect()  # a row a bucket
        if any(r.most > 1 or r.nulls for r in told):
            raise DuplicateKey(f"{self.key} is repeated or null in rows for {self.path}")
        touched, given = {r.b for r in told}, set(rows.columns) - {self.key}
        if not touched:
            return 0
        before = self._of(old, touched).withColumn("_old", F.lit(True)).alias("o")
        after = rows.select(F.col(self.key).cast(self.schema[self.key].dataType), *[c for c in rows.columns if c in self.schema.names and c != self.key]).withColumn("_new", F.lit(True)).alias("n")

        def value(field) -> Column:
            if field.name == self.key:
                return F.col(self.key)
            was = F.col(f"o.{field.name}")
            told = F.col(f"n.{field.name}").cast(field.dataType) if field.name in given else F.lit(None).cast(field.dataType)
            if field.name in self.insert_only:
                return F.when(F.col("_old"), was).otherwise(told)
            return F.when(F.col("_new"), told).otherwise(was) if field.name in given or whole else was

        both = before.join(after, self.key, "full")
        self._store(old, both.select(*[value(f).alias(f.name) for f in self.schema.fields]), touched)
        return sum(r.n for r in told)

    def _touching(self, old: dict, condition: Column) -> tuple[set[int], int]:
        hit = self.read(old["version"]) if old["version"] else self._load([])
        told = hit.where(condition).groupBy(self._bucket(old["buckets"]).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a bucket
        return {r.b for r in told}, sum(r.n for r in told)

    def update(self, condition: Column, **values: object) -> int:
        """Sets columns where the condition is true; the number of rows."""
        old = self.manifest()
        touched, n = self._touching(old, condition)
        if touched:
            hit = F.coalesce(condition, F.lit(False))
            set_to = {c: F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(self.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
            self._store(old, self._of(old, touched).withColumns(set_to), touched)
        return n

    def remove(self, condition: Column) -> int:
        """Removes rows for which the condition is true; their number."""
        old = self.manifest()
        touched, n = self._touching(old, condition)
        if touched:
            self._store(old, self._of(old, touched).where(~F.coalesce(condition, F.lit(False))), touched)
        return n

    def replace(self, condition: Column, rows: DataFrame) -> int:
        """``rows`` in place of those for which the condition is true, in one version: the links of one owner, for example. Rows of other keys stay."""
        old = self.manifest()
        keys = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).groupBy(self._bucket(old["buckets"]).alias("b")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
        if any(r.most > 1 for r in keys):
            raise DuplicateKey(f"{self.key} is repeated in rows for {self.path}")
        touched = self._touching(old, condition)[0] | {r.b for r in keys}
        if touched:
            left = self._of(old, touched).where(~F.coalesce(condition, F.lit(False)))
            if not left.join(rows.select(self.key), self.key, "left_semi").limit(1).isEmpty():
                raise DuplicateKey(f"{self.key} of another row is given to {self.path}")
            fresh = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])
            self._store(old, left.unionByName(fresh), touched)
        return sum(r.n for r in keys)

    def grow(self) -> bool:
        """Doubles the buckets while they hold too many rows; whether it did. Parquet's footers give the count."""
        old = self.manifest()
        number, rows = old["buckets"], self.read().count() if old["folders"] else 0
        while rows > MOST * number:
            number *= 2
        if number > old["buckets"]:
            self._store(old, self.read(), None, number)
        return number > old["buckets"]
