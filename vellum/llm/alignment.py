"""Alignment of two tokenizers' tokens, by a sweep over the events at which tokens end.

Each text is encoded by A (byte-level BPE, behind a space) and by B (pieces with byte fallback, which adds the space itself). Both cover the same bytes, so a token is known by
the offset at which it ends:

1. Tokens travel as blocks of up to ``BLOCK`` ids of one side with the offset of the first; an id fixes its number of bytes, and so all ends of the block.
2. Blocks of A and B are put together, dealt out by document and sorted by offset within their partition.
3. A state machine reads them in this order. Its state is what follows the last common end: the open group and at most a block a side. Where ends of A and B agree, a group is
   closed; between two neighbouring ends of either side lies one link, that of the two tokens that cover it. A document that is read through gives its counts, the digest
   of its groups, and how often it links which ids.
4. Counts of linked ids over the corpus, and the best of each B id, are made by aggregation, after each task has summed its own.
5. Pairs with at least a ``HOT``-th of all links are at most ``HOT``, so they are broadcast, and score most links where these are; the links of each rarer pair, which can't be many, meet their count by a join.

Texts that are null or empty, or whose tokens don't give back their bytes, have no tokens: zeros, and an empty string of groups. Repeated rows are documents of their own. A very long text is encoded in one task, some
20 bytes a byte; the sweep holds only its state, which grows with the longest group. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import keep, worker_cache
from vellum.llm.packing import Ids

#: Ids of a block; pairs that may be broadcast; links after which a task passes its sums on; cached units of B's text, their characters, and units that are looked up together.
BLOCK, HOT, SUMMED, UNITS, UNIT_CHARS, TOGETHER = 8192, 100_000, 2_000_000, 300_000, 40, 20_000
EVENTS = "rid long, doc_id long, at long, side int, ids binary"
SWEPT = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"


class ByteLevel:
    """A's ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        self.ids = Ids(path)
        self.ids.exact.encode_special_tokens, self.ids.added = True, []  # their strings are plain text here
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = self.ids.exact.get_vocab()
        self.bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.ids(" " + text), "<u4")


class Pieces:
    """B's ids of a text, and the bytes of each id.

    If no piece holds its mark of a space behind another character, no merge crosses from a word to the space behind it, so spaces with the word that
    follows are encoded by themselves, and remembered. Those that aren't known yet are encoded together, and cut where their bytes end.
    ASCII texts without neighbouring spaces go to ``tiktoken``, which merges bytes by rank as the model merges characters by score; see `_ranks` for what is checked when it is loaded.
    """

    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(self.SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.by_word = not any(re.search(f"[^{self.SPACE}]{self.SPACE}", p) for p in pieces) and self.model.encode("a  b ") == self.model.encode("a") + self.model.encode(" b") + self.unit(" ")
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.known: dict[str, bytes] = {}
        self.fast = self._ranks(pieces) if self.by_word else None

    def _ranks(self, pieces: list[str]):
        """The same merges by a faster engine, of ASCII words behind one space, if all pieces are plain or bytes, later ones have lower scores, and a word that is one piece is encoded as that piece."""
        try:
            import tiktoken
        except ImportError:
            return None
        model, ranks, joined = self.model, {self.bytes[i]: i for i in range(len(pieces)) if self.model.is_byte(i)}, []
        for i, piece in enumerate(pieces):
            if model.is_unused(i):
                return None
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or self.SPACE * 2 in piece):
                ranks[self.bytes[i]] = i
                joined += [i] if len(piece) > 1 else []
        scores = [model.get_score(i) for i in joined]
        units = [i for i in joined if self.bytes[i].isascii() and re.fullmatch(b" [^ ]*", self.bytes[i])]
        alike = all(a > b for a, b in zip(scores, scores[1:])) and all(self.unit(self.bytes[i].decode()) == [i] for i in units)
        if not alike or not all(bytes([b]) in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("pieces", pat_str=" [^ ]*", mergeable_ranks=ranks, special_tokens={})

    def unit(self, unit: str) -> list[int]:
        """Ids of spaces and the word behind them."""
        if unit.strip(" "):
            return self.model.encode(unit[1:])
        return self.model.encode("a" + unit)[len(self.model.encode("a")) :]

    def units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of different units."""
        words = [u for u in units if u.strip(" ")]
        raw = "".join(words)
        ids = self.model.encode(raw[1:]) if words else []
        if b"".join(map(self.bytes.__getitem__, ids)) == raw.encode("utf-8", "surrogatepass"):
            ends, bounds = np.cumsum(self.lengths[ids]), np.cumsum([len(u.encode("utf-8", "surrogatepass")) for u in words])
            last = np.searchsorted(ends, bounds, "right")
            if np.array_equal(ends[last - 1], bounds):
                flat, cuts = np.array(ids, "<u4").tobytes(), [0, *(4 * last).tolist()]
                made = {u: flat[a:b] for u, a, b in zip(words, cuts, cuts[1:])}
                return made | {u: np.array(self.unit(u), "<u4").tobytes() for u in units if u not in made}
        return {u: np.array(self.unit(u), "<u4").tobytes() for u in units}

    def _known(self, units: list[str]) -> list[bytes]:
        ids = list(map(self.known.get, units))
        if None in ids:
            made = self.units([u for u in dict.fromkeys(units) if u not in self.known])
            ids = [made[u] if x is None else x for u, x in zip(units, ids)]
            if len(self.known) + len(made) > UNITS:
                self.known.clear()
            self.known.update((u, x) for u, x in made.items() if len(u) <= UNIT_CHARS)
        return ids

    def __call__(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.array(self.model.encode(text), "<u4")
        if self.fast is not None and text.isascii() and "  " not in " " + text:
            return np.array(self.fast.encode_ordinary(" " + text), "<u4")
        units = re.findall(" +[^ ]*", " " + text)
        return np.frombuffer(b"".join(x for i in range(0, len(units), TOGETHER) for x in self._known(units[i : i + TOGETHER])), "<u4")


class Sweep:
    """The state machine of one document: takes blocks in the order of their offsets."""

    def __init__(self, doc_id: int | None, lengths: tuple[np.ndarray, np.ndarray], names: list[str]):
        self.doc_id, self.lengths, self.names = doc_id, lengths, names
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # behind the last common end, by side
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.number, self.groups, self.links, self.digest = [0, 0], 0, 0, hashlib.sha256()
        self.pairs: list[np.ndarray] = []

    def take(self, at: int, side: int, ids: np.ndarray) -> None:
        self.ids[side] = np.concatenate((self.ids[side], ids))
        self.ends[side] = np.concatenate((self.ends[side], at + np.cumsum(self.lengths[side][ids])))
        self.number[side] += len(ids)
        if not len(self.ends[1 - side]):
            return
        every = np.sort(np.concatenate(self.ends), kind="stable")
        again = every[1:] == every[:-1]
        both = every[1:][again]
        if len(both):
            self._close(both, every[np.append(True, ~again)])

    def _close(self, both: np.ndarray, every: np.ndarray) -> None:
        """Groups and links up to the last of the common ends ``both``, of all different ends ``every``."""
        cuts = [int(np.searchsorted(e, both[-1], "right")) for e in self.ends]
        ids, ends = [x[:n] for x, n in zip(self.ids, cuts)], [x[:n] for x, n in zip(self.ends, cuts)]
        self.ids, self.ends = [x[n:] for x, n in zip(self.ids, cuts)], [x[n:] for x, n in zip(self.ends, cuts)]
        # A link lies between neighbouring ends, of the tokens that end there or next.
        every = every[: np.searchsorted(every, both[-1], "right")]
        a, b = (i[np.searchsorted(e, every)] for i, e in zip(ids, ends))
        self.pairs.append(a.astype(np.int64) << 32 | b.astype(np.int64))
        self.links += len(every)
        # Each group's ids of A, then of B; the last of a side is followed by another mark.
        group = [np.searchsorted(both, e) for e in ends]
        order = np.argsort(np.concatenate((group[0] * 2, group[1] * 2 + 1)), kind="stable")
        codes = np.concatenate([i * 2 + np.append(g[1:] != g[:-1], True) for i, g in zip((ids[0], ids[1] + len(self.lengths[0])), group)])[order]
        said = "".join(map(self.names.__getitem__, codes.tolist()))
        self.digest.update(((";" if self.groups else "") + said[:-1]).encode())
        self.groups += len(both)

    def row(self, rid: int) -> tuple:
        pairs, counts = np.unique(np.concatenate(self.pairs), return_counts=True) if self.pairs else (np.zeros(0, np.int64),) * 2
        return rid, self.doc_id, *self.number, self.groups, self.links, self.digest.hexdigest() if self.links else "", pairs.astype("<i8").tobytes(), counts.astype("<i4").tobytes()


class Tokenizers:
    """Both tokenizers, with the tables of the sweep."""

    def __init__(self, a: str, b: str):
        self.sides = ByteLevel(a), Pieces(b)
        self.lengths = tuple(np.array([len(x) for x in s.bytes], np.int64) for s in self.sides)
        self.kinds = ["<u2" if len(s.bytes) <= 65536 else "<u4" for s in self.sides]
        self.names = [f"{i}{mark}" for side, last in zip(self.sides, "|;") for i in range(len(side.bytes)) for mark in ("," + last)]

    def events(self, text: str) -> Iterator[tuple[int, int, np.ndarray]]:
        """Blocks (offset, side, ids), none if the text has no tokens."""
        if not text:
            return
        raw, every = b" " + text.encode("utf-8", "surrogatepass"), []
        for side in self.sides:
            every.append(side(text))
            if b"".join(map(side.bytes.__getitem__, every[-1].tolist())) != raw:
                return
        for side, ids in enumerate(every):
            ends = np.cumsum(self.lengths[side][ids])
            for i in range(0, len(ids), BLOCK):
                yield int(ends[i - 1]) if i else 0, side, ids[i : i + BLOCK]


def tokenizers(a: str, b: str) -> Tokenizers:
    """Loaded once a worker."""
    cache = worker_cache()
    if (a, b) not in cache:
        cache[a, b] = Tokenizers(a, b)
    return cache[a, b]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows) if rows else [()] * len(fields), fields)], [n for n, _ in fields])


def events(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Blocks of the documents (rid, doc_id, text): rid, doc_id, at, side and ids; a single block without ids where there are no tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a, b)
        rows: list[tuple] = []
        for batch in batches:
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                blocks = [(rid, doc, at, side, ids.astype(both.kinds[side]).tobytes()) for at, side, ids in both.events(text.as_py() or "")]
                rows += blocks or [(rid, doc, 0, 0, b"")]
                if len(rows) >= 500:
                    yield _batch(rows, EVENTS)
                    rows.clear()
        yield _batch(rows, EVENTS)

    return docs.select("rid", "doc_id", "text").mapInArrow(encode, EVENTS)


def swept(blocks: DataFrame, a: str, b: str) -> DataFrame:
    """A row per document: its counts, digest and pairs of linked ids with their number."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a, b)
        state, current = None, None
        rows: list[tuple] = []
        for batch in batches:
            for rid, doc, at, side, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if rid != current:
                    if state:
                        rows.append(state.row(current))
                    state, current = Sweep(doc, both.lengths, both.names), rid
                state.take(at, side, np.frombuffer(ids.as_buffer(), both.kinds[side]).astype(np.int64))
            if len(rows) >= 200:
                yield _batch(rows, SWEPT)
                rows.clear()
        if state:
            rows.append(state.row(current))
        yield _batch(rows, SWEPT)

    return blocks.repartition("rid").sortWithinPartitions("rid", "at", "side").mapInArrow(sweep, SWEPT)


def _unpacked(batch: pa.RecordBatch, pairs: int, counts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's rows, all pairs, their counts, and how many each row has."""
    each = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(pairs)]
    number = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(counts)]
    return np.concatenate(each), np.concatenate(number).astype(np.int64), np.array([len(x) for x in each])


def linked(rows: DataFrame) -> DataFrame:
    """How often each pair of ids is linked over all rows (pairs, counts): pair, count, and best, whether that is its B id's highest."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], ["pair", "count"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                pairs, number, _ = _unpacked(batch, 0, 1)
                held.append((pairs, number))
                size += len(pairs)
            if size >= SUMMED:
                yield out()
                size = 0
        if held:
            yield out()

    pairs = rows.select("pairs", "counts").mapInArrow(total, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    best = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rid, n_best and count_sum of the rows (rid, pairs, counts), by the table ``pairs`` of `linked`."""
    spark = rows.sparkSession
    links = pairs.agg(F.sum("count")).first()[0] or 0
    # At most HOT pairs can have that many.
    hot = pairs.where(F.col("count") * F.lit(HOT) >= F.lit(links)).toArrow().sort_by("pair")
    keys, counts, best = (hot.column(i).to_numpy().astype(np.int64) for i in range(3))
    shared = spark.sparkContext.broadcast((np.append(keys, np.iinfo(np.int64).max), np.append(counts, 0), np.append(best, 0)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs, number, sizes = _unpacked(batch, 1, 2)
            at = np.searchsorted(keys, pairs)
            known = keys[at] == pairs
            row = np.repeat(np.arange(batch.num_rows), sizes)
            rid = batch.column(0).to_numpy()
            sums = [np.bincount(row[known], (number * x[at])[known], batch.num_rows).astype(np.int64) for x in (best, counts)]
            # A document's own row has a key of its own, that no pair has.
            cold, none = ~known, np.zeros(int((~known).sum()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in ((rid, rid[row[cold]]), (-1 - rid, pairs[cold]), (np.zeros(len(rid), np.int64), number[cold]), (sums[0], none), (sums[1], none))],
                ["rid", "pair", "number", "n_best", "count_sum"],
            )

    parts = rows.select("rid", "pairs", "counts").mapInArrow(score, "rid long, pair long, number long, n_best long, count_sum long").alias("r")
    joined = parts.join(pairs.alias("p"), F.col("r.pair") == F.col("p.pair"), "left")
    n_best = F.col("n_best") + F.when(F.col("p.best"), F.col("number")).otherwise(F.lit(0))
    count_sum = F.col("count_sum") + F.coalesce(F.col("number") * F.col("p.count"), F.lit(0))
    return joined.groupBy("rid").agg(F.sum(n_best).alias("n_best"), F.sum(count_sum).alias("count_sum"))


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Documents (doc_id, text) with the counts and groups of their tokens by the tokenizer files ``a`` and ``b``; see the module."""
    named = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, _ = keep(swept(events(named, a, b), a, b))
    pairs, drop = keep(linked(rows))
    scores, _ = keep(scored(rows, pairs))
    drop()
    return rows.join(scores, "rid").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
