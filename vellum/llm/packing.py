"""Best-fit packing of tokenised documents into sequences of fixed capacity.

A document becomes its token ids and an end id. One longer than the capacity is
cut into pieces, the first of which takes the remainder, so that all others are
full. Packing is bulk-synchronous best fit, in rounds over two tables, the pieces that wait and the gaps of open sequences:

1. Pieces longer than any gap open as many new sequences as their tokens fill.
2. Pieces and gaps are sorted into ranges by size, the largest first.
3. A sweep over a range gives each piece the successor of its size: the smallest gap of its range that holds it. What is left of that gap is a gap of
   the range again. What finds no partner in its range, pieces at its head and gaps that hold all that follows it, is ranked there; the counts of all ranges tell which
   ranks of which ranges match, as brackets do, and an equi-join on range and rank resolves them.
4. Gaps shrink by what they took, and the next round takes what waits. With several ranges, a gap that holds several of the longest waiting pieces stands for as
   many in a round, so that short pieces need few rounds.

No task takes more than a range, and ranges go on by id where many sizes are equal. The driver sees two counts a range. In the end pieces stand in their sequences in the
order of the rounds.

Null texts count as empty: one end id. Repeated rows are packed once each. A very long text is tokenised whole, in one task.
Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, worker_cache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Ids:
    """Token ids as ``tokenizers`` gives them for the vocabulary file at ``path``.

    Byte-level BPE files are also loaded as ranks into ``tiktoken``, which finds
    the same ids several times faster. That holds if every token is made by one merge and later merges make later ids, which
    is checked for the whole file. A text goes through ``tokenizers`` itself if the file is of another kind, if the text holds an added token's
    string, characters whose class may depend on an engine's version of Unicode (all beyond Cyrillic and general punctuation), or if the fast way fails.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    RARE = re.compile("[^\\x00-\u0481\u2010-\u2027\u2030-\u205e]")

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.exact, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if plain and model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and self._in_order(model):
            self.fast = self._ranks(model["vocab"])

    def _in_order(self, model: dict) -> bool:
        vocab = model["vocab"]
        made = [vocab.get("".join(x.split(" ") if isinstance(x, str) else x)) for x in model["merges"]]
        several = {i for t, i in vocab.items() if len(t) > 1 and t not in self.added}
        return None not in made and all(a < b for a, b in zip(made, made[1:])) and set(made) == several

    def _ranks(self, vocab: dict[str, int]):
        try:
            import tiktoken
        except ImportError:
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(shown[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        return tiktoken.Encoding("vocabulary", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.added) or (not text.isascii() and self.RARE.search(text)):
            return self._slow(text)
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as error:  # the engine's panics derive from BaseException
            if type(error).__name__ != "PanicException" and not isinstance(error, ValueError):
                raise
            return self._slow(text)


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the CRC-32 of its ids."""

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if tokenizer not in cache:
            cache[tokenizer] = Ids(tokenizer)
        encode = cache[tokenizer]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * 5, kinds)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate((0, *range(first, len(ids), capacity))):
                    length = first if not piece else capacity
                    rows.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            yield out()
            rows.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_texts, PIECES)


#: Rows of a range, and ranges, at most.
RANGE, RANGES = 100_000, 20_000
SWEPT = "part int, kind string, at long, pid long, length int, sequence long, gap int"


def swept(items: DataFrame, ranges: int) -> DataFrame:
    """Pieces and gaps (size, piece, id, gap) in ranges of descending size, by best fit within each: kind ``match``, or what is left: ``piece`` or ``gap``, with its rank, or ``rest``, a gap too small for what follows its range."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, waiting, size = TaskContext.get().partitionId(), 0, 0
        gaps: list[tuple[int, int, int]] = []  # size (negative, so the largest first), sequence, its whole gap
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], [x.split()[0] for x in SWEPT.split(", ")])

        for batch in batches:
            rows = []
            for size, piece, number, gap in zip(*(c.to_pylist() for c in batch.columns)):
                if not piece:
                    insort(gaps, (-size, number, gap))
                    continue
                at = bisect_left(gaps, (1 - size,)) - 1
                if at < 0:
                    rows.append((part, "piece", waiting, number, size, None, None))
                    waiting += 1
                    continue
                room, sequence, whole = gaps.pop(at)
                rows.append((part, "match", 0, number, size, sequence, whole))
                if room + size:
                    insort(gaps, (room + size, sequence, whole))
            if rows:
                yield out(rows)
        for i in range(0, len(gaps), 10_000):
            yield out([(part, "gap" if -room >= size else "rest", j, None, None, sequence, whole) for j, (room, sequence, whole) in enumerate(gaps[i : i + 10_000], i)])

    order = [F.col("size").desc(), F.col("piece"), F.col("id")]
    rows = items.select("size", "piece", "id", "gap")
    # One range is one task of at most RANGE rows, whatever number of partitions the session prefers.
    dealt = rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.repartition(1)
    return dealt.sortWithinPartitions(*order).mapInArrow(sweep, SWEPT)


def brackets(counts: list[tuple[int, int, int]]) -> tuple[list[tuple], dict[int, int]]:
    """Of (range, pieces, gaps) in order: runs (piece range, first rank, number, gap range, its last rank), and the number of matched pieces of each range."""
    runs, matched = [], {}
    stack: list[list[int]] = []  # gaps that are left: range, number
    for part, pieces, gaps in counts:
        rank = 0
        while rank < pieces and stack:
            held = stack[-1]
            n = min(pieces - rank, held[1])
            runs.append((part, rank, n, held[0], held[1] - 1))
            rank, held[1] = rank + n, held[1] - n
            if not held[1]:
                stack.pop()
        matched[part] = rank
        if gaps:
            stack.append([part, gaps])
    return runs, matched


def rounds(pieces: DataFrame, capacity: int) -> DataFrame:
    """pid, sequence_id, length and turn of the pieces (pid, length)."""
    spark = pieces.sparkSession
    left, gaps = pieces.select("pid", F.col("length").cast("int").alias("length")), None
    placed, opened, turn, most, n_gaps = [], 0, 0, 0, 0
    while True:
        longer = F.when(F.col("length") > most, F.col("length")).otherwise(F.lit(0))
        n, top, least, tokens = left.agg(F.count(F.lit(1)), F.max("length"), F.min("length"), F.sum(longer)).first()
        if not n:
            break
        # New sequences are as many as their pieces fill; older gaps stand for several only where pieces outnumber them.
        fresh, several = -(-tokens // capacity), 1 + n // max(1, n_gaps)
        ranges = max(1, min(RANGES, -(-(n + n_gaps + fresh) // RANGE)))
        most_lanes = several if ranges > 1 else 1  # within a range, what is left of a gap is a gap again
        lanes = F.explode(F.sequence(F.lit(1), F.col("lanes"))).alias("lane")
        mine = spark.range(opened, opened + fresh).select(F.col("id").alias("sequence"), F.lit(capacity).alias("gap"), F.lit(max(1, capacity // top) if ranges > 1 else 1).alias("lanes"))
        if gaps is not None:
            mine = gaps.where(F.col("gap") >= least).withColumn("lanes", F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / F.lit(top)), F.lit(most_lanes))).cast("int")).union(mine)
        mine = mine.select("sequence", "gap", "lanes", lanes).select(F.floor(F.col("gap") / F.col("lanes")).cast("int").alias("size"), F.lit(False).alias("piece"), F.col("sequence").alias("id"), "gap")
        items = left.select(F.col("length").alias("size"), F.lit(True).alias("piece"), F.col("pid").alias("id"), F.lit(None).cast("int").alias("gap")).union(mine)
        opened += fresh
        done = cut(swept(items, ranges))
        found = done.where("kind = 'match'").select("pid", "sequence", "gap", "length")
        waits, rest = done.where("kind = 'piece'"), done.where("kind in ('gap', 'rest')").select("sequence", "gap", F.lit(0).alias("length"))
        counts = done.groupBy("part").agg(F.count(F.when(F.col("kind") == "piece", 1)).alias("pieces"), F.count(F.when(F.col("kind") == "gap", 1)).alias("gaps")).collect()  # a row a range
        runs, matched = brackets(sorted(map(tuple, counts)))
        if runs:
            plan = F.broadcast(spark.createDataFrame(runs, "part int, first long, number long, gap_part int, last long"))  # two a range at most
            meets = waits.join(plan, "part").where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("number")))
            meets = meets.select("pid", "length", F.col("gap_part").alias("part"), (F.col("last") - (F.col("at") - F.col("first"))).alias("at"))
            found = found.union(cut(meets.join(done.where("kind = 'gap'").select("part", "at", "sequence", "gap"), ["part", "at"]).select("pid", "sequence", "gap", "length")))
            # Of a range's waiting pieces, the first ones have found a gap.
            waits = waits.join(F.broadcast(spark.createDataFrame(list(matched.items()), "part int, gone long")), "part").where(F.col("at") >= F.col("gone"))
        placed.append(found.select("pid", F.col("sequence").alias("sequence_id"), "length", F.lit(turn).alias("turn")))
        # What a sequence's lanes took is taken from its whole gap; gaps that were too small for the shortest piece stay so.
        gaps = found.select("sequence", "gap", "length").union(rest).groupBy("sequence").agg((F.max("gap") - F.sum("length")).cast("int").alias("gap")).where("gap > 0")
        left, turn = waits.select("pid", "length"), turn + 1
        n_gaps, most = gaps.agg(F.count(F.lit(1)), F.coalesce(F.max("gap"), F.lit(0))).first()
    every = spark.range(0).select(F.col("id").alias("pid"), F.col("id").alias("sequence_id"), F.lit(0).alias("length"), F.lit(0).alias("turn"))
    for found in placed:
        every = every.union(found)
    return every


def packed(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (their columns, with length) with sequence_id and offset."""
    rows = cut(pieces.withColumn("pid", F.monotonically_increasing_id()))
    inside = Window.partitionBy("sequence_id").orderBy("turn", "pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stands = rounds(rows, capacity).select("pid", "sequence_id", (F.sum("length").over(inside) - F.col("length")).cast("long").alias("offset"))
    return rows.join(stands, "pid").drop("pid")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Documents (doc_id, text) as pieces in sequences; see the module."""
    return packed(tokenised(docs, tokenizer, capacity, end_id), capacity)
