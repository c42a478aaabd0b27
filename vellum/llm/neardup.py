"""Near-duplicate documents by BagMinHash signatures over multisets of word shingles.

A document is the multiset of its five-word shingles (fewer words: one shingle of them all). For each
shingle, Poisson processes run over dyadic intervals of its weight axis, [0,1), [1,2), [2,4) and so
on, up to its multiplicity; the points depend on shingle and interval alone, each
point goes to one of the signature's components, and counts if its position on the weight
axis is below the multiplicity. A component keeps its earliest point, so two components agree
with a probability equal to the weighted Jaccard similarity. A process stops when its time
passes all components' earliest, which makes large documents cost little more than one point a shingle.

Components are banded; texts that share a band are candidates, and verification
computes the multiset overlap itself. With 32 bands of 4, a pair of similarity 0.8 shares no band with probability 5e-8.
Exact copies are one text. Candidates are not expanded into all pairs: in each band's group the texts are verified
against the group's leader, the text that shares bands with most others, and verified links are joined to components. Then
only groups that still span several components are looked at again: groups of up to ``PAIRS``
texts compare all pairs between components; larger ones compare with leaders
that change from round to round,
the most central texts of random parts, until a round finds few links. The texts of larger groups that span several components
even then are joined exactly, by a prefix filter: with each set's shingles in one order, rare ones first, near sets share one
of the first (1 - similarity) * size, and behind the first that they share enough of both is left. Only such pairs between components are verified, once each.

Rows without words (null, empty or blank texts) are each a class of their own. Repeated rows are copies of
each other. Extra columns are ignored, or kept by ``distinct``, whatever their names. An empty table gives no rows. A very long text is shingled at once, in some
tens of bytes a byte, and its shingle set (8 bytes a word) is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, keep

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
#: Texts of a group whose pairs between components are all compared.
PAIRS = 48
#: Leaders of a larger group in each further round.
LEADERS = 4
#: What is known of one of a text's shingles that near texts must meet by; about how many of these are put together in a bucket.
ENTRY, ENTRIES = np.dtype([("value", "<u8"), ("text", "<i8"), ("root", "<i8"), ("size", "<i4"), ("rank", "<i4")]), 1 << 14
#: Shingles whose counts are broadcast (16 bytes each); shingles or pairs that a task holds at once.
COMMON, SUMMED = 100_000, 1 << 20
#: Candidate texts up to this number are broadcast as ids of 16 bytes.
SMALL = 200_000
#: Bytes of text that are shingled at a time.
SLICE = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int, cache: dict) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    if len(cache.get(base, ())) <= n:
        steps = np.full(max(n + n // 4, 1 << 18) + 1, base, np.uint64)
        steps[0] = 1
        cache[base] = np.cumprod(steps, dtype=np.uint64)
    return cache[base]


def hashed_words(texts: list[bytes], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word, in order."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    base = 0x2545F4914F6CDD1D
    up, down = powers(base, len(buffer), cache), powers(pow(base, -1, 1 << 64), len(buffer), cache)
    values = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(values[buffer] * up[: len(buffer)], out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * down[starts])
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return np.searchsorted(first, starts, "right") - 1, words


def shingles(texts: list[bytes], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle, sorted by both; a hash occurs as often as its shingle does."""
    owner, words = hashed_words(texts, cache)
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    last = np.ones(n, bool)  # does a whole shingle start here
    owners, padded = np.append(owner, [-1] * SHINGLE), np.append(words, np.zeros(SHINGLE, np.uint64))
    for j in range(SHINGLE):
        there = owners[j : n + j] == owner
        total = mixed(total + np.where(there, padded[j : n + j], np.uint64(0)) * np.uint64(2 * j + 3))
        last &= there
    opens = np.ones(n, bool)
    opens[1:] = owner[1:] != owner[:-1]
    short = opens & ~last
    use = last | short
    owner, total = owner[use], total[use]
    order = np.lexsort((total, owner))
    return owner[order], total[order]


def occurrences(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted shingles: where each distinct one begins, and its multiplicity."""
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(fresh)
    return at, np.diff(at, append=len(owner))


def signatures(owner: np.ndarray, hashes: np.ndarray, n_texts: int, size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash: for each text the earliest times per component; infinite for texts without shingles."""
    at, weight = occurrences(owner, hashes)
    owner, hashes = owner[at], hashes[at]
    parts = []
    level, low, width = 0, 0, 1
    while len(owner):
        parts.append((owner, mixed(hashes + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64))), np.full(len(owner), low), np.full(len(owner), width), weight))
        level, low, width = level + 1, low + width, max(1, low + width)
        more = weight > low
        owner, hashes, weight = owner[more], hashes[more], weight[more]
    sign = np.full((n_texts, size), np.inf)
    if not parts:
        return sign
    text, seed, low, width, weight = (np.concatenate(x) for x in zip(*parts))
    time, flat, step = np.zeros(len(text)), sign.reshape(-1), 0
    while len(text):
        step += 1
        draw = mixed(seed + np.uint64(step * int(_STEP) % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width
        draw = mixed(draw ^ _STEP)
        place = (draw % np.uint64(size)).astype(np.int64)
        position = low + width * ((draw >> np.uint64(24)).astype(float) * 2.0**-40)
        counts = position < weight
        np.minimum.at(flat, text[counts] * size + place[counts], time[counts])
        go = time < sign.max(1)[text]
        text, seed, low, width, weight, time = (x[go] for x in (text, seed, low, width, weight, time))
    return sign


def band_keys(sign: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(sign).view(np.uint64).reshape(len(sign), BANDS, ROWS)
    key = np.zeros((len(sign), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for r in range(ROWS):
        key = mixed(key ^ bits[:, :, r])
    return key.view(np.int64)


def as_set(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A multiset's shingles as a set: the n-th occurrence of a hash gets a value of its own."""
    at, weight = occurrences(owner, hashes)
    nth = np.arange(len(hashes)) - np.repeat(at, weight)
    return mixed(hashes + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in pieces of about SLICE bytes."""
    texts, begin, held = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        raw = (text.as_py() or "").encode()
        texts.append(raw)
        held += len(raw)
        if held >= SLICE:
            yield begin, texts
            texts, begin, held = [], i + 1, 0
    if texts:
        yield begin, texts


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text with near_a and near_b, two hashes that stand for the text; near_words: has it any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("near_a"), F.xxhash64(F.lit(7), text).alias("near_b"), text.rlike(r"[^\x20\x09-\x0D]").alias("near_words"), *more)


def banded(rows: DataFrame) -> DataFrame:
    """near_a, doc_id and the band keys of each of ``rows``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for begin, texts in _slices(batch, 2):
                keys = band_keys(signatures(*shingles(texts, cache), len(texts)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, len(texts)) for i in (0, 1)), flat], ["near_a", "doc_id", "near_keys"])

    return rows.select("near_a", "doc_id", "text").mapInArrow(made, "near_a long, doc_id long, near_keys array<long>")


def contents(rows: DataFrame) -> DataFrame:
    """near_a and the shingle set, as sorted 64-bit values, of each text of ``rows``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for begin, texts in _slices(batch, 1):
                owner, hashes = shingles(texts, cache)
                values = as_set(owner, hashes)
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                sets = [np.sort(values[bounds[i] : bounds[i + 1]]).tobytes() for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(sets, pa.binary())], ["near_a", "near_set"])

    return rows.select("near_a", "text").mapInArrow(made, "near_a long, near_set binary")


def small(table: DataFrame) -> DataFrame:
    """A kept table of ids, which a join broadcasts if it has at most SMALL rows."""
    return F.broadcast(table) if table.count() <= SMALL else table


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of a kept table whose multisets are similar enough.

    Few pairs go to the sets, and the two sets of a pair meet by the pair: what stands in very many pairs is in one task no more than others.
    """
    x, y = sets.select(F.col("near_a").alias("u"), F.col("near_set").alias("su")), sets.select(F.col("near_a").alias("v"), F.col("near_set").alias("sv"))
    if pairs.count() <= SMALL:
        both = x.join(F.broadcast(pairs), "u").join(y.join(F.broadcast(pairs), "v"), ["u", "v"]).select("u", "v", "su", "sv")
    else:
        both = pairs.join(x, "u").join(y, "v").select("u", "v", "su", "sv")

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            stay = []
            for a, b in zip(frame.column(2), frame.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                least, most = sorted((len(a), len(b)))
                if least < similarity * most:
                    stay.append(False)
                    continue
                both_ways = np.sort(np.concatenate([a, b]), kind="stable")
                common = int((both_ways[1:] == both_ways[:-1]).sum())
                stay.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            mask = pa.array(stay, pa.bool_())
            yield pa.RecordBatch.from_arrays([frame.column(0).filter(mask), frame.column(1).filter(mask)], ["u", "v"])

    return both.mapInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """near_a and root of every node of a kept table of links (u, v): smallest labels spread over links, and each label jumps to its own label, until none changes."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    labels, drop_labels = keep(both.groupBy(F.col("u").alias("near_a")).agg(F.least(F.first("u"), F.min("v")).alias("root")))
    few = labels.count() <= SMALL
    while True:
        known = labels.select(F.col("near_a").alias("v"), F.col("root").alias("said"))
        known = F.broadcast(known) if few else known
        said = both.join(known, "v").select(F.col("u").alias("near_a"), F.col("said").alias("root"), F.lit(None).cast("long").alias("was"))
        own = labels.select("near_a", "root", F.col("root").alias("was"))
        lower = said.union(own).groupBy("near_a").agg(F.min("root").alias("root"), F.max("was").alias("was"))
        step = lower.join(known, F.col("root") == F.col("v")).select("near_a", F.least("root", "said").alias("root"), (F.col("was") != F.least("root", "said")).alias("moved"))
        step, drop_step = keep(step)
        drop_labels()
        labels, drop_labels = step.select("near_a", "root"), drop_step
        if step.where("moved").isEmpty():
            return labels


def usual(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that fill at least a COMMON-th of all sets, at most COMMON of them, in order, with about how many sets have each: a task passes on what it has seen twice."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], ["value", "n"])

        for batch in batches:
            for one in batch.column(0):
                held.append(np.frombuffer(one.as_buffer(), np.uint64))
                size += len(held[-1])
                if size >= SUMMED:
                    yield out()
                    size = 0
        if held:
            yield out()

    total = texts.agg(F.sum(F.octet_length("near_set") / 8)).first()[0] or 0
    found = texts.select("near_set").mapInArrow(seen, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") * F.lit(COMMON) >= F.lit(total)).toArrow()
    values, n = found["value"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


def prefixes(sets: list[np.ndarray], texts: np.ndarray, roots: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Entries of the first shingles of each set, rare ones first: two sets that are near share one of these."""
    values, often = common
    size = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    n = np.zeros(len(flat), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        n = np.where(values[at] == flat, often[at], 0)
    order = np.lexsort((flat, n, owner))  # one order of all shingles, in every task
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    use = rank <= (1 - similarity) * size[owner] + 1e-6
    made = np.zeros(int(use.sum()), ENTRY)
    made["value"], made["rank"] = flat[order][use], rank[use]
    for name, column in (("text", texts), ("root", roots), ("size", size)):
        made[name] = column[owner[use]]
    return made


def meetings(entries: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts of different components that may be near, by what their first common shingle leaves behind it.

    Of near sets x and y at least ``share * (x + y)`` shingles are common, and none lies before the first common one. Where that
    is another entry of theirs, a pair may be refused here; it is found there. Within a shingle's largest component nothing is compared.
    """
    share = similarity / (1 + similarity)
    entries = entries[np.lexsort((entries["size"], entries["value"]))]
    value, root, size = entries["value"], entries["root"], entries["size"].astype(np.int64)
    listed = np.cumsum(np.append(False, value[1:] != value[:-1]))
    by = np.lexsort((root, listed))
    start = np.flatnonzero(np.append(True, (listed[by][1:] != listed[by][:-1]) | (root[by][1:] != root[by][:-1])))
    n, of = np.diff(start, append=len(by)), listed[by][start]
    last = np.lexsort((n, of))
    largest = np.zeros(len(start), bool)
    largest[last[np.append(of[last][1:] != of[last][:-1], True)]] = True
    main = np.zeros(len(entries), bool)
    main[by] = np.repeat(largest, n)
    key, behind = listed << 32 | size, size - entries["rank"]
    low, high = (listed << 32 | np.ceil(similarity * size - 1e-6).astype(np.int64)), (listed << 32 | np.floor(size / similarity + 1e-6).astype(np.int64))
    rest = np.flatnonzero(~main)
    found, held = [np.zeros((0, 2), np.int64)], 0
    for others in (rest, np.flatnonzero(main)):
        at, end = np.searchsorted(key[others], low[rest], "left"), np.searchsorted(key[others], high[rest], "right")
        if others is rest:
            at = np.maximum(at, np.arange(1, len(rest) + 1))  # each pair once
        left = np.flatnonzero(at < end)
        while len(left):
            x, y = rest[left], others[at[left]]
            good = (root[x] != root[y]) & (np.minimum(behind[x], behind[y]) >= share * (size[x] + size[y]) - 1e-6)
            found.append(np.sort(np.stack([entries["text"][x[good]], entries["text"][y[good]]], 1), axis=1))
            held += len(found[-1])
            if held >= SUMMED:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = 0
            at[left] += 1
            left = left[at[left] < end[left]]
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def packed(texts: DataFrame, similarity: float, buckets: int) -> DataFrame:
    """bucket and entries (`prefixes` of texts (near_a, root, near_set), with all of a shingle in one bucket)."""
    shared = texts.sparkSession.sparkContext.broadcast(usual(texts))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            names, roots, sets = zip(*rows)
            entries = prefixes(list(sets), np.array(names, np.int64), np.array(roots, np.int64), shared.value, similarity)
            bucket = (entries["value"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            kinds, at = np.unique(bucket[order], return_index=True)
            parts = [x.tobytes() for x in np.split(entries[order], at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(parts, pa.binary())], ["bucket", "entries"])

        rows, size = [], 0
        for batch in batches:
            for name, root, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rows.append((name, root, np.frombuffer(one.as_buffer(), np.uint64)))
                size += len(rows[-1][2])
                if size >= SUMMED:
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)

    return texts.select("near_a", "root", "near_set").mapInArrow(made, "bucket long, entries binary")


def across(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of roots: all that near pairs between components make among the texts of rows (near_a, root).

    A text is sent once, with the few shingles by which near texts must meet, however many groups it is in and however large they are.
    """
    roots, drop_roots = keep(rows.select("near_a", "root").distinct())
    texts, drop_texts = keep(sets.join(small(roots), "near_a").select("near_a", "root", "near_set"))
    size = texts.agg(F.sum((1 - similarity) * F.octet_length("near_set") / 8 + 1)).first()[0] or 0
    buckets = 1 + int(size) // ENTRIES

    def meet(table: pa.Table) -> pa.Table:
        u, v = meetings(np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for x in table["entries"]]), similarity)
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    pairs = cut(packed(texts, similarity, buckets).groupBy("bucket").applyInArrow(meet, "u long, v long").distinct())
    found = cut(rooted(verified(pairs, texts.select("near_a", "near_set"), similarity), roots).distinct())
    drop_texts()
    drop_roots()
    return found


def rooted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``links`` (u, v) as links of the roots that the kept table ``labels`` gives; others are their own."""
    by = small(labels)
    for end in ("u", "v"):
        links = links.join(by.select(F.col("near_a").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
    return links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after a kept table of links (u, v) between roots. Only components are linked anew: the graph of their roots is small."""
    merged = components(links)
    moved = labels.join(small(merged).select(F.col("near_a").alias("root"), F.col("root").alias("top")), "root", "left").select("near_a", F.coalesce("top", "root").alias("root"))
    return cut(moved.union(merged.join(small(labels), "near_a", "left_anti")))


def linked(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """near_a and root of the texts that have a near-duplicate."""
    rows = keyed(docs).where("near_words")
    bands, drop_bands = keep(banded(rows).groupBy("near_a").agg(F.min("doc_id").alias("own_id"), F.first("near_keys").alias("near_keys")))
    every = bands.select("near_a", F.explode("near_keys").alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found_groups, drop_found = keep(every.join(shared, "key").select("key", "near_a", "n"))
    # A text whose bands many texts share is likely the one that copies were made from, and near to most of them.
    central, drop_central = keep(found_groups.groupBy("near_a").agg(F.sum("n").alias("score")))
    groups, drop_groups = keep(found_groups.join(small(central), "near_a").select("key", "near_a", "n", "score"))
    drop_found()
    owners, drop_owners = keep(bands.join(small(central), "near_a", "left_semi").select(F.col("near_a").alias("own_a"), "own_id"))
    once = rows.join(small(owners), (F.col("near_a") == F.col("own_a")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi")
    sets, drop_sets = keep(contents(once).dropDuplicates(["near_a"]))
    leaders = groups.groupBy("key").agg(F.max(F.struct("score", "near_a"))["near_a"].alias("leader"))
    pairs = groups.join(leaders, "key").where("near_a <> leader").select(F.least("leader", "near_a").alias("u"), F.greatest("leader", "near_a").alias("v")).distinct()
    tested = cut(pairs)
    labels = components(cut(verified(tested, sets, similarity)))
    turn = 0
    while True:
        turn += 1
        placed = groups.join(small(labels), "near_a", "left").select("key", "near_a", "n", "score", F.coalesce("root", "near_a").alias("root"))
        # The most central text of each of some random parts of a group, other parts in each round.
        part = F.pmod(F.xxhash64("near_a", F.lit(turn)), F.lit(LEADERS))
        leads = [F.max(F.when(part == i, F.struct("score", "near_a", "root"))).alias(f"l{i}") for i in range(LEADERS)]
        split = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), *leads).where("least < most")
        # The greatest of them is the group's leader, which all of it has been verified against.
        leads = F.sort_array(F.array_compact(F.array(*[f"l{i}" for i in range(LEADERS)])))
        open_rows, drop_open = keep(placed.join(split.select("key", F.slice(leads, F.lit(1), F.size(leads) - 1).alias("leads")), "key"))
        few = open_rows.where(F.col("n") <= PAIRS).select("key", "near_a", "root")
        within = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.near_a") < F.col("b.near_a")) & (F.col("a.root") != F.col("b.root"))).select(F.col("a.near_a").alias("u"), F.col("b.near_a").alias("v"))
        many = open_rows.where(F.col("n") > PAIRS).select("near_a", F.explode(F.filter("leads", lambda x: x["root"] != F.col("root"))).alias("lead")).select(F.least("near_a", "lead.near_a").alias("u"), F.greatest("near_a", "lead.near_a").alias("v"))
        fresh = cut((within.union(many) if turn == 1 else many).distinct().join(small(tested), ["u", "v"], "left_anti"))
        found = cut(verified(fresh, sets, similarity))
        # What so few links join has no more pairs than were just compared: the exact join finds the rest of it in place of further rounds.
        if found.count() ** 2 <= 2 * fresh.count():
            break
        drop_open()
        tested = cut(tested.union(fresh))
        labels = joined(labels, cut(rooted(found, labels).where("u <> v").distinct()))
    links, rest = rooted(found, labels), open_rows.where(F.col("n") > PAIRS).select("near_a", "root")
    if not rest.isEmpty():
        links = links.union(across(rest, sets, similarity))
    links = cut(links.where("u <> v").distinct())
    labels = labels if links.isEmpty() else joined(labels, links)
    drop_open()
    for drop in (drop_bands, drop_central, drop_groups, drop_owners, drop_sets):
        drop()
    return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """near_a, near_b, class_id, class_size and first (the row that stands for the class: doc_id, near_a, near_b; null ids come last) of every text with words."""
    texts = keyed(docs).where("near_words").groupBy("near_a", "near_b").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    placed = texts.join(linked(docs, similarity), "near_a", "left").select("near_a", "near_b", "doc_id", "n", F.coalesce("root", "near_a").alias("r1"), F.when(F.col("root").isNull(), F.col("near_b")).otherwise(F.lit(0)).alias("r2"))
    placed = cut(placed)
    named = placed.groupBy("r1", "r2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "near_a", "near_b")).alias("first"), F.sum("n").alias("class_size"))
    return placed.select("near_a", "near_b", "r1", "r2").join(named, ["r1", "r2"]).select("near_a", "near_b", F.col("first.doc_id").alias("class_id"), "class_size", "first")


def assign(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size and kept (is it that document) of every document (doc_id, text)."""
    rows = keyed(docs).drop("text")
    alone = rows.where(~F.col("near_words")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    found = rows.where("near_words").join(classes(docs, similarity), ["near_a", "near_b"]).select("doc_id", "class_id", "class_size")
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def distinct(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, and all without words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("near_a"), F.xxhash64(F.lit(7), text).alias("near_b"), text.rlike(r"[^\x20\x09-\x0D]").alias("words"))
    first = classes(docs, similarity).where((F.col("near_a") == F.col("first.near_a")) & (F.col("near_b") == F.col("first.near_b"))).select(F.col("class_id").alias("c_id"), F.col("near_a").alias("c_a"), F.col("near_b").alias("c_b"))
    kept = rows.where("words").join(first, (F.col("near_a") == F.col("c_a")) & (F.col("near_b") == F.col("c_b")) & F.col("id").eqNullSafe(F.col("c_id")), "left_semi")
    again = F.row_number().over(Window.partitionBy("near_a", "near_b", "id").orderBy("id"))
    return kept.withColumn("nth", again).where("nth = 1").select("doc").unionByName(rows.where(~F.col("words")).select("doc")).select("doc.*")
