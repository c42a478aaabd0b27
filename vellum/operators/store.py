"""The operational store: upserts, replacements and deletes over keyed tables, as new tables."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(own)).where("_rn = 1").drop("_rn")


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, by an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Old and new rows, of equal keys the greatest version; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return last_per_key(both, keys, [*version, "_new"]).drop("_new")


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], insert_only: list[str]) -> DataFrame:
    """New values over old ones, but for ``insert_only`` columns of rows that exist."""
    rest = [c for c in old.columns if c not in keys]
    on = functools.reduce(operator.and_, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])
    joined = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), on, "full")
    take = lambda c: F.when(F.col("o._o").isNotNull() & (F.col("n._n").isNull() | F.lit(c in insert_only)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return joined.select(*[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys], *[take(c).alias(c) for c in rest])


def replace_links(links: DataFrame, owner: str, owner_id: object, wanted: DataFrame) -> DataFrame:
    """All links of one owner replaced by ``wanted``."""
    return links.where(F.col(owner) != F.lit(owner_id)).unionByName(wanted)


def requested(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The distinct requested keys that are known."""
    return asked.select(key).distinct().join(known, key, "left_semi")


def totals(rows: DataFrame, source: str, name: str, order: str) -> DataFrame:
    """chunks, the number of rows of each source, and name, that of its last row; combined before the shuffle."""
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("chunks"), F.max_by(name, order).alias("name"))


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def cascade_delete(parent: DataFrame, children: dict[str, DataFrame], key: str, doomed: DataFrame, hard: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents are flagged deleted (or removed); their children are removed. Children keep their partitioning."""
    left = {name: rows.join(doomed.select(key), key, "left_anti") for name, rows in children.items()}
    if hard:
        return parent.join(doomed.select(key), key, "left_anti"), left
    marked = parent.join(doomed.select(key, F.lit(True).alias("_gone")), key, "left")
    return marked.withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).drop("_gone"), left


def counts(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """n per key and its rank, most common first, ties by first appearance."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "first_seen")))


def search(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with ``term`` in any of the columns, whatever the case."""
    hits = [F.contains(F.lower(F.col(c)), F.lower(F.lit(term))) for c in columns]
    return rows.where(functools.reduce(operator.or_, hits))
