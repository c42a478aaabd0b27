"""Recursive character splitting, and identity of chunks."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = 1000, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` code points, split at the coarsest separator that is present; neighbours share up to ``overlap``."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        head, *rest = text.split(separator)
        pieces = [p for p in (head, *(separator + x for x in rest)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    window: deque[str] = deque()

    def emit() -> None:
        if joined := "".join(window).strip():
            out.append(joined)

    held = 0
    for piece in pieces:
        if len(piece) > size:
            if window:
                emit()
            window, held = deque(), 0
            out.extend(split_text(piece, size, overlap, finer) if finer else [piece])
            continue
        if held + len(piece) > size and window:
            emit()
            while held > overlap or (held and held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        emit()
    return out


def split_column(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    """The pieces of stripped texts. One of at most ``size`` code points is its own piece, and only longer ones leave the JVM."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else split_text(x, size, overlap))

    short = (F.length(text) <= size) & ~text.rlike("^[\\x1c-\\x1f]|[\\x1c-\\x1f]$")
    return F.coalesce(F.when(short, F.filter(F.array(text), lambda x: x != "")), split(F.when(~short, text)), F.array().cast("array<string>"))


def chunks(records: DataFrame, size: int = 1000, overlap: int = 150, compose: bool = True) -> DataFrame:
    """Records (text, source_hash, document_type, page, slide, section, ord) as identified chunks.

    source_hash null: each record's own cleaned text gives the source.
    """
    rows = records.withColumn("text", T.clean_text(F.col("text"), compose)).where("text <> ''")
    kind = T.document_type(F.col("document_type"))
    rows = rows.withColumn("sourceId", T.source_id(kind, F.coalesce("source_hash", T.content_hash(F.col("text")))))
    pieces = rows.select("*", F.posexplode(split_column(F.col("text"), size, overlap)).alias("piece_ord", "chunk"))
    order = Window.partitionBy("sourceId").orderBy("ord", "piece_ord")
    pieces = pieces.withColumn("chunkIndex", (F.row_number().over(order) - 1).cast("long"))
    return pieces.withColumn("chunkId", T.chunk_id(F.col("sourceId"), F.col("chunkIndex"), F.col("chunk"))).withColumn("location", T.location_key(F.col("page"), F.col("slide"), F.col("section")))
