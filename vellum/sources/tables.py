"""Tables as Parquet."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Workers need no copy of this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules["vellum"])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores: a small table may be one file of one row group, which one task would read and work on. Tables of enough splits stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
