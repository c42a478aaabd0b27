"""Periodic runs of words, by a vectorised scan of all lags.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and ``times`` periods long, that no
neighbouring word extends. Every lag from 1 to a document's words / ``times`` is tried: the array of word ids is compared with itself shifted by the lag,
and stretches of equal words become runs by their length. Two things keep that quick, and lose nothing:

* A stretch that counts at lag q is at least m = max(least - q, (times - 1) * q) long, so four neighbours of the positions 0, s, 2s, ... with s = m // 4 lie in
  it. A lag is compared at these positions first, and in full only in documents where four neighbours in a row agree.
* Documents of a batch are compared together, longest first: word ids differ between documents, and a longer lag compares fewer of them.

A stretch of a multiple of its smallest period has the same words as the stretch of that period, so the least lag of (start, end) is the period.

Texts of up to ``ALONE`` characters are scanned where they are read. For longer ones, ranges of ``LAGS`` lags are dealt over all
tasks, each with its text, and the runs of a text meet again. A task holds some ten bytes a byte of one text.

Null and empty texts have no words and no runs. A null doc_id leaves its text unplanted. Repeated rows give a row each. Among runs of equal exponent the first start, then the
shortest period, is shown. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import keep

#: Characters of a text whose lags one task scans, lags of a range beyond it, and words that are compared together.
ALONE, LAGS, TOGETHER = 400_000, 20_000, 400_000
RUNS = "rid long, start long, stop long, period long"
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the contract of the query plants in a tenth of all documents, by the CRC-32 of doc_id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def unplanted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    return words


def stretches(ids: np.ndarray, lag: int, floor: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches [start, stop) of positions whose word comes again ``lag`` words on, of at least ``floor``."""
    same = np.concatenate(([False], ids[:-lag] == ids[lag:], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, stops = edges[::2], edges[1::2]
    for i in np.flatnonzero(stops - starts >= floor):
        yield int(starts[i]), int(stops[i])


def scan(texts: list[np.ndarray], first: int = 1, last: int | None = None, least: int = 24, times: int = 3) -> list[dict[tuple[int, int], int]]:
    """For each array of word ids, its runs (start, stop) with the least lag of ``first`` to ``last`` at which they show."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    order = sorted((i for i, x in enumerate(texts) if len(x) >= max(least, times * first)), key=lambda i: -len(texts[i]))
    if not order:
        return found
    sizes = np.array([len(texts[i]) for i in order])
    begins = np.concatenate(([0], np.cumsum(sizes)))
    # Ids of different documents differ, so that nothing is equal across a border.
    shifts = np.concatenate(([0], np.cumsum([int(texts[i].max()) + 1 for i in order])))
    whole = np.concatenate([texts[i] + s for i, s in zip(order, shifts)]).astype(np.int64 if shifts[-1] > 2**31 - 1 else np.int32)
    alive = len(order)
    for lag in range(first, min(int(sizes[0]) // times, last or int(sizes[0])) + 1):
        while sizes[alive - 1] < times * lag:
            alive -= 1
        ids, floor = whole[: begins[alive]], max(least - lag, (times - 1) * lag, 1)
        step = max(1, floor // 4)
        same = ids[: len(ids) - lag : step] == ids[lag::step]
        if floor >= 4:
            same = same[:-3] & same[1:-2] & same[2:-1] & same[3:]
        hits = np.flatnonzero(same) * step
        for d in np.unique(np.searchsorted(begins, hits, "right") - 1) if len(hits) else ():
            runs = found[order[d]]
            for start, stop in stretches(whole[begins[d] : begins[d + 1]], lag, floor):
                runs.setdefault((start, stop + lag), lag)
    return found


def coded(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    codes: dict[bytes, int] = {}
    return np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)


def told(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """A row of the result from a document's runs (start, stop, period)."""
    runs = sorted((s, q, e) for s, e, q in runs)
    gone = np.zeros(len(words), bool)
    for s, q, e in runs:
        gone[s + q : e] = True
    kept = words if not runs else [w for w, g in zip(words, gone.tolist()) if not g]
    lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
    s, q, e = min(runs, key=lambda r: (-Fraction(r[2] - r[0], r[1]), r[0], r[1])) if runs else (None, None, None)
    shown = (s, e - s, q, 1000 * (e - s) // q) if runs else (None,) * 4
    return doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in fields]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * len(fields), kinds)], [n for n, _ in fields])


def detected(docs: DataFrame, least: int = 24, times: int = 3, plant: bool = False) -> DataFrame:
    """A row per document (doc_id, text) with its runs' number and digest, its strongest run, and the digest of its words without repetitions; see the module.

    ``plant`` first makes a tenth of the documents periodic, as the query's contract says.
    """
    change = planted if plant else unplanted
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    raw = F.col("text").cast("binary").alias("text")

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[bytes]]] = []

        def done() -> pa.RecordBatch:
            runs = scan([coded(words) for _, words in held], least=least, times=times)
            out = _rows([told(doc, words, [(*k, q) for k, q in found.items()]) for (doc, words), found in zip(held, runs)], RESULT)
            held.clear()
            return out

        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = change(text.as_py().split(), doc)  # bytes.split() takes the six white-space bytes of ASCII
                held.append((doc, words))
                size += len(words) + 10
                if size >= TOGETHER:
                    yield done()
                    size = 0
        yield done()

    long = F.length("text") > ALONE
    short = rows.where(~long).select("doc_id", raw).mapInArrow(here, RESULT)

    # Long texts: equal rows are scanned once, and their lags by ranges.
    texts, _ = keep(rows.where(long).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times")).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "times"))
    most = F.floor(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) / F.lit(times))
    firsts: Column = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), most).cast("int"), F.lit(LAGS))).alias("first")
    ranges = texts.select("rid", "doc_id", raw, firsts)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, doc, text, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                runs = scan([coded(change(text.as_py().split(), doc))], first, first + LAGS - 1, least, times)[0]
                if runs:
                    yield _rows([(rid, *k, q) for k, q in runs.items()], RUNS)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, n, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                row = told(doc, change(text.as_py().split(), doc), [(r["start"], r["stop"], r["period"]) for r in runs or ()])
                yield _rows([row] * n, RESULT)

    runs = ranges.repartition("rid", "first").mapInArrow(part, RUNS).groupBy("rid", "start", "stop").agg(F.min("period").alias("period"))
    runs = runs.groupBy("rid").agg(F.collect_list(F.struct("start", "stop", "period")).alias("runs"))  # of one text
    return short.union(texts.join(runs, "rid", "left").select("doc_id", raw, "times", "runs").mapInArrow(finish, RESULT))
