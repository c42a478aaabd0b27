"""Grouped text cards: entries of a group in order, so many to a card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped(rows: DataFrame, keys: list[str], order: list[str], entry: Column, size: int, separator: str = "\n", first: list[str] | None = None) -> DataFrame:
    """keys, part (from 1), n_entries of the group, and the card's entries joined by ``separator``; ``first`` columns come from a card's first row.

    A group's rows are numbered by a window; a card then gathers at most ``size`` of them.
    """
    own = Window.partitionBy(*keys)
    numbered = rows.withColumn("entry", entry).withColumn("rn", F.row_number().over(own.orderBy(*order))).withColumn("n_entries", F.count(F.lit(1)).over(own))
    numbered = numbered.withColumn("part", (F.floor((F.col("rn") - 1) / size) + 1).cast("long"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "entry"))), lambda x: x["entry"]), separator)
    return numbered.groupBy(*keys, "n_entries", "part").agg(body.alias("body"), F.count(F.lit(1)).alias("n_in_card"), *[F.min_by(c, "rn").alias(c) for c in first or []])


def sliced(rows: DataFrame, keys: list[str], items: str, size: int) -> DataFrame:
    """A row per slice of an array column: part (from 1) and items; slices of only blank items are left out, but counted."""
    from vellum.functions.text import slices

    parts = rows.select(*keys, F.posexplode(slices(F.col(items), size)).alias("part", "items")).withColumn("part", (F.col("part") + 1).cast("long"))
    return parts.withColumn("items", F.filter("items", lambda x: F.coalesce(x, F.lit("")) != "")).where(F.size("items") > 0)
