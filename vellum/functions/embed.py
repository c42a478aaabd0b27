"""Vectors of texts without a model file: signed feature hashing, which is a sparse random projection of the counts of words.

Each word adds +1 or -1 to ``SPREAD`` of the dimensions, all of which its MD5 names, so vectors of any two runs, machines and engines agree. Vectors have unit length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

PROVIDER, MODEL, DIMENSIONS, SPREAD = "vellum", "hashed-words-64", 64, 4
#: Texts that are counted at once.
ROWS = 256


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The dimensions of each word and their signs, ``SPREAD`` of each."""
    named = np.frombuffer(b"".join(hashlib.md5(w).digest()[: 2 * SPREAD] for w in words), ">u2").reshape(-1, SPREAD).astype(np.int64)
    return named % DIMENSIONS, 1 - named // DIMENSIONS % 2 * 2


def counts(texts: DataFrame, key: str) -> DataFrame:
    """``key`` and ``counts``, the signed counts of all dimensions, of the texts (key, text) with a word. A text is counted where it is: no word is sent to another task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                lists = batch.column(1)
                coded = lists.flatten().dictionary_encode()
                sizes = pc.list_value_length(lists).to_numpy()
                dimension, sign = places(coded.dictionary.cast(pa.binary()).to_pylist())
                at, row = coded.indices.to_numpy(), np.repeat(np.arange(len(lists)) * DIMENSIONS, sizes)
                summed = np.zeros(len(lists) * DIMENSIONS)
                for j in range(SPREAD):
                    summed += np.bincount(row + dimension[at, j], sign[at, j], len(summed))
                some = np.flatnonzero(sizes)
                found = pa.array(summed.astype(np.int64).reshape(-1, DIMENSIONS)[some].ravel())
                ends = pa.array(np.arange(len(some) + 1) * DIMENSIONS, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(ends, found)], [key, "counts"])

    rows = texts.select(key, words(F.coalesce("text", F.lit(""))).alias("words"))
    return rows.mapInArrow(count, StructType([texts.schema[key], StructField("counts", ArrayType(LongType()))]))


def vectors(texts: DataFrame, key: str) -> DataFrame:
    """``key`` and ``vector`` of the texts (key, text); none for a text without words, or whose counts cancel out."""
    norm = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda s, x: s + x * x))
    return counts(texts, key).withColumn("norm", norm).where("norm > 0").select(key, F.transform("counts", lambda x: x / F.col("norm")).alias("vector"))
