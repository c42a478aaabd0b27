"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_TABLES: list[Callable[[], None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none, one beside the warehouse.

    A warehouse on the machine's own disk is shared only if all runs on this machine, so on a cluster it is refused.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_vellum"
            if not context.master.startswith("local") and named.split(":", 1)[0] in ("file", named):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def keep(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a compressed table in the shared folder, computed once, and a call that deletes it when no plan reads it any more.

    It survives lost executors, as the folder is on reliable storage. What isn't deleted goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)

    def drop() -> None:
        context = spark.sparkContext
        if context._jsc is not None:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        if drop in _TABLES:
            _TABLES.remove(drop)

    if not _TABLES:
        atexit.register(_drop_all)
    _TABLES.append(drop)
    return spark.read.schema(df.schema).parquet(path), drop


def _drop_all() -> None:
    for drop in list(_TABLES):
        with contextlib.suppress(Exception):  # the session may be gone already
            drop()
