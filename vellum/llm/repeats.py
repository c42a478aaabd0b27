"""Removal of long repeated byte strings, by a difference cover of sampled suffixes.

Every byte is removed that a string of ``SPAN`` bytes covers which also starts anywhere else, in
the same text or another. Suffix sorting would find these as neighbours with a
common prefix of SPAN bytes. Here the suffixes are sampled first, as a difference-cover algorithm does, but by content
instead of residues: of the K-grams that start in a window, the one with the least hash is its
anchor, so equal windows have equal anchors, about one position in a hundred is an anchor, and what differs
between two texts doesn't shift the samples of the rest.

1. Sampled suffixes are named by their K-gram; a name that occurs once can't begin a repeat and is dropped.
2. Names are refined to the whole context of a sample, the bytes of all windows that have it
   as their anchor; a context that occurs twice is repeated as a whole.
3. The remaining suffixes, the windows between samples, are only looked at where a name has
   several contexts, once per context. They are merged in blocks of ``STEP`` starts, counted back from the sample, so that equal windows are in
   blocks of one number. A block's core, what all of its windows share, is named first: if it occurs once, none of them repeats. If all
   contexts with a core agree in its hull, what its windows cover together, all of them repeat. Only the windows of other
   blocks, at the ends of repeats, are named by their own SPAN bytes, and equal names are merged.

Names are 128-bit fingerprints (64 bits for the K-grams, which only select), so that each step is one
hash aggregation instead of a sort by ranks. Copies cost what one text costs, plus a row per sample.

Null texts are empty. Texts below SPAN bytes are kept whole. Repeated rows are copies of each other and are removed
like them. Extra columns are ignored, whatever their names. An empty table gives no rows. A text of any length is fingerprinted in slices of ``SLICE`` starts, which go on SPAN - 1 bytes,
in some 60 bytes a byte of a slice. A window's anchor doesn't depend on its slice; a context that a border cuts is two contexts, which step 3 tells apart as it does all others.

Passages of over 50 words that stand elsewhere too may be shorter than SPAN bytes; they are kept, and `passages` counts their words. It samples in the same way, by words:
windows of ``PASSAGE`` words have their least gram of ``GRAM`` words as anchor, and where an anchor occurs twice, the windows that have it are named.

Sums modulo 2^64 are weak on Thue-Morse words, which take 1,024 bytes to be so; a context has less than 2 * SPAN.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, keep
from vellum.llm.neardup import _slices, hashed_words, mixed, powers

SPAN = 400
#: Rows up to this number are broadcast as ids of 16 bytes.
SMALL = 200_000
_BASES = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
_PLACE = np.uint64((1 << 28) - 1)
RUNS = "sa_id long, sa_text long, name long, c1 long, c2 long, skip int, lo int, hi int"
#: Starts of a block, and of a slice.
STEP, SLICE = 16, 4 << 20
#: Words of a window, and of the grams that anchor it.
PASSAGE, GRAM = 51, 25


class Prints:
    """Fingerprints of a text's substrings, from two prefix sums."""

    def __init__(self, raw: bytes, cache: dict):
        data = np.frombuffer(raw, np.uint8)
        self.n, self.sums, self.down = len(data), [], []
        for i, base in enumerate(_BASES):
            if (key := ("bytes", i)) not in cache:
                cache[key] = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * i))
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(cache[key][data] * powers(base, self.n, cache)[: self.n], out=sums[1:])
            self.sums.append(sums)
            self.down.append(powers(pow(base, -1, 1 << 64), self.n, cache))

    def __call__(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        sums = self.sums[which]
        return mixed((sums[end] - sums[start]) * self.down[which][start] + (end - start).astype(np.uint64))


def slices(raw: bytes, span: int, cache: dict) -> Iterator[tuple[np.ndarray, ...]]:
    """`runs_of` the slices of a text, with places in the text."""
    for start in range(0, len(raw) - span + 1, SLICE):
        name, c1, c2, skip, lo, hi = runs_of(raw[start : start + SLICE + span - 1], span, cache)
        yield name, c1, c2, skip, lo + start, hi + start


def runs_of(raw: bytes, span: int, cache: dict) -> tuple[np.ndarray, ...]:
    """(name, c1, c2, skip, lo, hi) of each run of windows lo..hi that have the same anchor, at lo + skip. ``raw`` is shorter than 2 ** 28."""
    k = span // 2
    windows, wide = len(raw) - span + 1, span - k + 1
    prints = Prints(raw, cache)
    grams = len(raw) - k + 1
    at = np.arange(grams)
    names = prints(at, at + k, 0)
    packed = (names & ~_PLACE) | at.astype(np.uint64)
    blocks = -(-grams // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = packed
    grid = padded.reshape(blocks, wide)
    onward = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(back[:windows], onward[wide - 1 : wide - 1 + windows]) & _PLACE).astype(np.int64)
    lo = np.flatnonzero(np.diff(anchor, prepend=-1))
    hi = np.append(lo[1:], windows) - 1
    return names[anchor[lo]], prints(lo, hi + span, 0), prints(lo, hi + span, 1), anchor[lo] - lo, lo, hi


def _raw(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("sa_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("sa_text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _runs(rows: DataFrame, span: int) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            parts, owners = [], []
            for i, text in enumerate(batch.column(2)):
                if len(raw := _raw(text)) >= span:
                    for found in slices(raw, span, cache):
                        parts.append(found)
                        owners += [i] * len(found[0])
                if owners and (len(owners) > 100_000 or i == batch.num_rows - 1):
                    of = pa.array(owners)
                    flat = [np.concatenate(x) for x in zip(*parts)]
                    hashes, bounds = [pa.array(x.view(np.int64)) for x in flat[:3]], [pa.array(x.astype(np.int32)) for x in flat[3:]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *hashes, *bounds], [x.split()[0] for x in RUNS.split(", ")])
                    parts, owners = [], []

    long_enough = rows.where(F.octet_length("text") >= span)
    return long_enough.select("sa_id", "sa_text", "text").mapInArrow(made, RUNS)


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups of n: the group and the place in it of every member."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _named(rows: DataFrame, span: int, schema: str, parts) -> DataFrame:
    """``parts`` (prints, anchor, lo, hi, blocks) -> (context, columns after c1 and c2) over rows (text, contexts: array of c1, c2, skip, lo, hi, blocks)."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for text, contexts in zip(batch.column(0), batch.column(1)):
                raw, inner = _raw(text), contexts.values
                c1, c2, skip, lo, hi = (inner.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("c1", "c2", "skip", "lo", "hi"))
                order = np.argsort(lo, kind="stable")
                # Contexts of a slice, all of which it holds, some at a time.
                for of_slice in np.split(order, np.flatnonzero(np.diff(lo[order] // SLICE)) + 1):
                    base = int(lo[of_slice[0]])
                    prints = Prints(raw[base : int(hi[of_slice].max()) + span], cache)
                    for i in range(0, len(of_slice), 2000):
                        some = of_slice[i : i + 2000]
                        of, *columns = parts(prints, lo[some] + skip[some] - base, lo[some] - base, hi[some] - base, inner.field("blocks").take(pa.array(some)))
                        if len(of):
                            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((c1[some][of], c2[some][of], *columns), kinds)], names)

    return rows.select("text", "contexts").mapInArrow(made, schema)


def _blocks(span: int):
    """Every block b of contexts, which holds the starts that are b * STEP to b * STEP + STEP - 1 before the anchor: b, the core's names, and the hull's, null where it isn't all in the context."""

    def parts(prints, anchor, lo, hi, _) -> tuple:
        first, last = (anchor - hi) // STEP, (anchor - lo) // STEP
        of, b = _spread(last - first + 1)
        b = b + first[of]
        late = anchor[of] - b * STEP  # the block's last start; its first is early
        early = late - (STEP - 1)
        w1, w2 = (prints(late, early + span, i).view(np.int64) for i in (0, 1))
        whole = (early >= lo[of]) & (late <= hi[of])
        hull = prints(np.where(whole, early, 0), np.where(whole, late + span, 0), 0).view(np.int64)
        return of, b.astype(np.int32), w1, w2, pa.array(hull, mask=~whole)

    return parts


def _windows(span: int):
    """The windows of some blocks: offset from the context's first, and names."""

    def parts(prints, anchor, lo, hi, blocks) -> tuple:
        b = np.asarray(blocks.flatten(), np.int64)
        context = np.repeat(np.arange(len(lo)), np.diff(blocks.offsets.to_numpy()))
        of, step = _spread(np.full(len(b), STEP, np.int64))
        context, start = context[of], (anchor[context] - b * STEP)[of] - step
        inside = (start >= lo[context]) & (start <= hi[context])
        context, start = context[inside], start[inside]
        return context, (start - lo[context]).astype(np.int32), *(prints(start, start + span, i).view(np.int64) for i in (0, 1))

    return parts


def _of(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    small = ids.count() <= SMALL
    return rows.join(F.broadcast(ids) if small else ids, ["sa_id", "sa_text"], how)


def covered(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """sa_id, sa_text and the repeated parts (array of start, end; in bytes, unordered, they may overlap) of each text that has any."""
    rows = keyed(docs)
    runs, drop_runs = keep(_runs(rows, span))
    often, drop_often = keep(runs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    candidates, drop_candidates = keep(runs.join(often, "name", "left_semi"))
    drop_runs()
    drop_often()
    contexts, drop_contexts = keep(candidates.groupBy("name", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sa_id", "sa_text", "skip", "lo", "hi")).alias("at")))
    unclear = contexts.groupBy("name").agg(F.count(F.lit(1)).alias("n_contexts")).where("n_contexts > 1").select("name")
    several, drop_several = keep(contexts.join(unclear, "name", "left_semi").select("c1", "c2", "at.*").dropDuplicates(["c1", "c2"]))

    def texts(of: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
        """text and contexts of the first place of each context of ``of``."""
        places, drop = keep(of.groupBy("sa_id", "sa_text").agg(F.collect_list(F.struct("c1", "c2", "skip", "lo", "hi", "blocks")).alias("contexts")))
        return _of(rows, places.select("sa_id", "sa_text"), "left_semi").dropDuplicates(["sa_id", "sa_text"]).join(places, ["sa_id", "sa_text"]), drop

    named, drop_named = texts(several.withColumn("blocks", F.array().cast("array<int>")))
    blocks, drop_blocks = keep(_named(named, span, "c1 long, c2 long, b int, w1 long, w2 long, hull long", _blocks(span)))
    drop_named()
    agree = (F.count("hull") == F.count(F.lit(1))) & (F.min("hull") == F.max("hull"))
    cores, drop_cores = keep(blocks.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.coalesce(agree, F.lit(False)).alias("agree")).where("n > 1").select("w1", "w2", "agree"))
    met, drop_met = keep(blocks.join(cores, ["w1", "w2"]).groupBy("c1", "c2").agg(F.collect_list(F.when(F.col("agree"), F.col("b"))).alias("whole"), F.collect_list(F.when(~F.col("agree"), F.col("b"))).alias("blocks")))
    drop_blocks()
    drop_cores()
    named, drop_named = texts(several.join(met.where(F.size("blocks") > 0).select("c1", "c2", "blocks"), ["c1", "c2"]))
    windows, drop_windows = keep(_named(named, span, "c1 long, c2 long, offset int, w1 long, w2 long", _windows(span)))
    drop_named()
    drop_several()
    again, drop_again = keep(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"))
    parts = windows.join(again, ["w1", "w2"], "left_semi").groupBy("c1", "c2").agg(F.collect_list("offset").alias("offsets"))
    hits = contexts.select("c1", "c2", "n").dropDuplicates(["c1", "c2"]).join(met.select("c1", "c2", "whole"), ["c1", "c2"], "left").join(parts, ["c1", "c2"], "left")
    hits, drop_hits = keep(hits.where((F.col("n") > 1) | (F.size("whole") > 0) | F.col("offsets").isNotNull()))
    whole = F.array(F.struct(F.col("lo").alias("start"), (F.col("hi") + span).alias("end")))
    span_of = lambda first, last: F.struct(first.alias("start"), (last + span).alias("end"))
    late = F.col("lo") + F.col("skip")
    in_blocks = F.transform("whole", lambda b: span_of(late - b * STEP - (STEP - 1), late - b * STEP))
    alone = F.transform("offsets", lambda x: span_of(F.col("lo") + x, F.col("lo") + x))
    none = F.array().cast("array<struct<start:int,end:int>>")
    inside = F.concat(F.coalesce(in_blocks, none), F.coalesce(alone, none))
    found = candidates.join(hits, ["c1", "c2"]).select("sa_id", "sa_text", F.when(F.col("n") > 1, whole).otherwise(inside).alias("spans"))
    found = cut(found.groupBy("sa_id", "sa_text").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    for drop in (drop_candidates, drop_contexts, drop_met, drop_windows, drop_again, drop_hits):
        drop()
    return found


def _anchored(texts: list[bytes], passage: int, gram: int, cache: dict) -> tuple[np.ndarray, ...]:
    """Of every window of ``passage`` words: text number, first word, anchor's place and name, and two names of its own."""
    owner, words = hashed_words(texts, cache)
    windows, wide = len(words) - passage + 1, passage - gram + 1
    if windows < 1:
        none = np.empty(0, np.int64)
        return (none,) * 6
    sums, down = [], []
    for i, base in enumerate(_BASES):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mixed(words + np.uint64(i)) * powers(base, len(words), cache)[: len(words)], out=total[1:])
        sums.append(total)
        down.append(powers(pow(base, -1, 1 << 64), len(words), cache))

    def named(n: int, which: int) -> np.ndarray:
        count = len(words) - n + 1
        return mixed((sums[which][n:] - sums[which][:count]) * down[which][:count])

    names = named(gram, 0)
    packed = (names & ~_PLACE) | np.arange(len(names), dtype=np.uint64)
    blocks = -(-len(names) // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(names)] = packed
    grid = padded.reshape(blocks, wide)
    onward = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(back[:windows], onward[wide - 1 : wide - 1 + windows]) & _PLACE).astype(np.int64)
    at = np.flatnonzero(owner[:windows] == owner[passage - 1 :])
    place = at - np.searchsorted(owner, owner[at])
    return owner[at], place, anchor[at], names[anchor[at]].view(np.int64), named(passage, 0)[at].view(np.int64), named(passage, 1)[at].view(np.int64)


def passages(rows: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """sa_id, sa_text and n_passage_words, the words in passages of ``passage`` words that also start anywhere else, of each text of ``rows`` that has any."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for begin, texts in _slices(batch, 2):
                of, _, anchor, name, _, _ = _anchored(texts, passage, gram, cache)
                fresh = np.flatnonzero(np.diff(anchor, prepend=-1))
                part = batch.slice(begin, len(texts))
                where = pa.array(of[fresh])
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), pa.array(name[fresh])], ["sa_id", "sa_text", "name"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for begin, texts in _slices(batch, 2):
                of, place, _, name, w1, w2 = _anchored(texts, passage, gram, cache)
                part = batch.slice(begin, len(texts))
                wanted = part.column(3)
                owner = np.repeat(np.arange(len(texts)), np.diff(wanted.offsets.to_numpy()))
                both = pa.table({"of": of, "name": name, "i": np.arange(len(of))}).join(pa.table({"of": owner, "name": wanted.flatten()}), ["of", "name"], join_type="left semi")
                use = np.sort(both["i"].to_numpy())
                where = pa.array(of[use])
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), pa.array(place[use], pa.int32()), pa.array(w1[use]), pa.array(w2[use])], ["sa_id", "sa_text", "place", "w1", "w2"])

    found, drop_found = keep(rows.select("sa_id", "sa_text", "text").mapInArrow(anchors, "sa_id long, sa_text long, name long"))
    often, drop_often = keep(found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    places, drop_places = keep(found.join(often, "name", "left_semi").groupBy("sa_id", "sa_text").agg(F.collect_set("name").alias("names")))
    drop_found()
    drop_often()
    some = _of(rows, places.select("sa_id", "sa_text"), "left_semi").join(places, ["sa_id", "sa_text"])
    named, drop_named = keep(some.select("sa_id", "sa_text", "text", "names").mapInArrow(windows, "sa_id long, sa_text long, place int, w1 long, w2 long"))
    again, drop_again = keep(named.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"))
    starts = F.sort_array(F.collect_set("place"))
    hits = named.join(again, ["w1", "w2"], "left_semi").groupBy("sa_id", "sa_text").agg(starts.alias("at"))
    gaps = F.zip_with(F.slice("at", 2, F.size("at")), F.slice("at", 1, F.size("at") - 1), lambda b, a: F.least(b - a, F.lit(passage)))
    counted = cut(hits.select("sa_id", "sa_text", F.aggregate(gaps, F.lit(passage), lambda n, x: n + x).cast("long").alias("n_passage_words")))
    for drop in (drop_places, drop_named, drop_again):
        drop()
    return counted


def merged(spans: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes."""
    start, end = (spans.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "end"))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > end[:-1]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)
    return start[fresh], end[last]


def _cut_out(rows: DataFrame, keys: str, schema: str, row) -> DataFrame:
    """The columns ``keys`` and ``row`` (raw text, starts, ends) -> values of ``schema``, over rows (keys, text, spans)."""
    passed, names = [x.split()[0] for x in keys.split(", ")], [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row(_raw(text), *merged(spans.values)) for text, spans in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(x, kind) for x, kind in zip(zip(*out) if out else [()] * len(kinds), kinds))], [*passed, *names])

    return rows.select("text", "spans", *passed).mapInArrow(made, f"{keys}, {schema}")


def kept_pieces(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    bounds = [0, *(int(x) for pair in zip(starts, ends) for x in pair), len(raw)]
    return [raw[a:b] for a, b in zip(bounds[::2], bounds[1::2])]


def _judged(docs: DataFrame, span: int) -> DataFrame:
    """`removed`, behind sa_id and sa_text."""
    found, rows = covered(docs, span), keyed(docs)
    ids = found.select("sa_id", "sa_text")
    plain = _of(rows, ids, "left_anti").select("sa_id", "sa_text", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))

    def digest(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
        whole = hashlib.sha256()
        for piece in kept_pieces(raw, starts, ends):
            whole.update(piece)
        return len(raw), int((ends - starts).sum()), len(starts), whole.hexdigest()

    hit = _of(rows, ids, "left_semi").join(found, ["sa_id", "sa_text"])
    done = plain.unionByName(_cut_out(hit, "sa_id long, sa_text long, doc_id long", "n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest))
    return done.withColumns({"n_kept": F.col("n_bytes") - F.col("n_removed"), "repeated": F.col("n_removed") > 0})


def removed(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept and repeated (is anything removed) of every document (doc_id, text)."""
    return _judged(docs, span).drop("sa_id", "sa_text")


def reported(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """`removed` and n_passage_words, the words in passages of over 50 words that also start anywhere else: these are kept where they are below ``span`` bytes."""
    done, shared = _judged(docs, span), passages(keyed(docs))
    both = done.join(F.broadcast(shared) if shared.count() <= SMALL else shared, ["sa_id", "sa_text"], "left").drop("sa_id", "sa_text")
    return both.withColumn("n_passage_words", F.coalesce("n_passage_words", F.lit(0).cast("long")))


def cleaned(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id and kept (the remaining bytes; a cut may fall inside a character) of every document."""
    found, rows = covered(docs, span), keyed(docs)
    ids = found.select("sa_id", "sa_text")
    plain = _of(rows, ids, "left_anti").select("doc_id", F.col("text").cast("binary").alias("kept"))
    hit = _of(rows, ids, "left_semi").join(found, ["sa_id", "sa_text"])
    return plain.unionByName(_cut_out(hit, "doc_id long", "kept binary", lambda raw, a, b: (b"".join(kept_pieces(raw, a, b)),)))
