"""Helpers that the training-data operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources import tables
from vellum.sources.shared import keep
from vellum.sources.tables import spread

# Workers need no copy of this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules["vellum"])

#: White space and words as the operators' contracts define them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once per row however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Number of words; null counts as a text without words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A double strictly between 0 and 1, made of 52 bits of an MD5 of the parts (null: empty)."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: a table that stays until the driver ends, as the result may be read at any time."""
    return keep(df)[0]


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, over tasks."""
    return sys.modules.setdefault("_vellum_worker", types.ModuleType("_vellum_worker")).__dict__


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder, over all cores."""
    return spread(tables.table(spark, sf_dir, table))
