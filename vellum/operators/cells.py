"""Exact nearest vectors of many probes, by cells, triangle bounds and a carried k-th distance.

Vectors lie in the cell of their nearest centre; a cell has a radius, that of its farthest vector, and its vectors are packed into blocks of some ``BLOCK``. Probes are packed
by their own nearest centre, so those of a pack ask for the same cells.

1. A pack searches its nearest cells, as many as hold k vectors. Each probe has a k-th distance then.
2. No vector of a cell is nearer than the probe's distance to the centre less the radius. A pack goes on only to cells in which that bound is within a probe's k-th distance.

Search is a join of packs with blocks by (part, cell, block), and a matrix product in each pair. With ``part``, probes find vectors of their own part only; centres are those of all. A hot cell is many
blocks and a hot centre many packs, so no task holds either. Centres are drawn by hash, at most ``CENTRES``, and broadcast (8 bytes times the length each); everything else meets in joins.

Null vectors, and those with null or non-finite elements or of another length than the probes', take no part. Equal distances go by vec_id. Probes are of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.sources.shared import keep

#: Vectors of a block, probes of a pack, centres at most, and cells' summaries that may be broadcast.
BLOCK, PACK, CENTRES, SUMMARIES = 2048, 256, 1024, 50_000


def finite(vector: Column, length: int) -> Column:
    """The vector as doubles, or null if it can't be compared."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fits = (F.size(vector) == length) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fits, doubles)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _packed(members: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Ids and matrix of one row's list of (id, vector)."""
    inner = members.flatten()
    return inner.field(0), _matrix(inner.field(1))


def centres(vectors: DataFrame) -> np.ndarray:
    """A vector in about the square root of their number, drawn by hash."""
    number = vectors.count()
    drawn = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(CENTRES, int(number**0.5))))
    rows = drawn.collect()  # at most CENTRES
    return np.array([r.v for r in rows], np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows, good to some 1e-7 of the longest."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def placed(rows: DataFrame, middle) -> DataFrame:
    """``rows`` (id, part, v) with their nearest centre, cell, and the exact distance to it, gap."""
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = middle.value
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(2))
                cell = _distances(v, points).argmin(1).astype(np.int32)
                gap = np.sqrt(((v - points[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], ["id", "part", "v", "cell", "gap"])

    return rows.select("id", "part", "v").mapInArrow(place, f"id {kind}, part string, v array<double>, cell int, gap double")


def packs(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Placed rows in packs (part, cell, block, members) of some ``size``, and the summary of each cell: part, cell, n, radius, blocks."""
    summary, _ = keep(rows.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).withColumn("blocks", F.ceil(F.col("n") / size).cast("int")))
    near = summary.select("part", "cell", "blocks")
    if summary.limit(SUMMARIES + 1).count() <= SUMMARIES:
        near = F.broadcast(near)
    blocked = rows.join(near, ["part", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return blocked.groupBy("part", "cell", "block").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("members")), summary  # some ``size`` a group


def _first_cells(d: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The cells nearest to the pack, as many as hold ``k`` vectors: a mask."""
    order = np.argsort(d.min(0), kind="stable")
    mask = np.zeros(len(n), bool)
    mask[order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]] = True
    return mask


def _pairs(packed: DataFrame, middle, k: int, later: bool) -> DataFrame:
    """Pairs (pid, part, cell, block) that are to be searched: the first cells, or all others within the bounds of ``kth``."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = middle.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                _, asked = _packed(row.column(2))
                cells = row.column(3).flatten()
                number, n, radius, blocks = (cells.field(j).to_numpy(zero_copy_only=False) for j in range(4))
                d = _distances(asked, points[number])
                wanted = _first_cells(d, n, k)
                if later:
                    kth = np.array([np.inf if x is None else x for x in row.column(4).flatten().to_pylist()])
                    slack = 1e-6 * (1 + d.max())
                    wanted = ~wanted & (d - radius[None] <= kth[:, None] + slack).any(0)
                at = np.flatnonzero(wanted)
                cell = np.repeat(number[at], blocks[at]).astype(np.int32)
                block = np.concatenate([np.arange(b, dtype=np.int32) for b in blocks[at]]) if len(at) else np.zeros(0, np.int32)
                pid, part = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([pid] * len(cell), pa.int64()), pa.array([part] * len(cell), pa.string()), pa.array(cell), pa.array(block)], ["pid", "part", "cell", "block"])

    return packed.select("pid", "part", "members", "cells", *(["kth"] if later else [])).mapInArrow(plan, "pid long, part string, cell int, block int")


def _searched(pairs: DataFrame, packed: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each probe in each pair's block: probe_id, part, vec_id, distance; none beyond the probe's ``kth``."""
    kinds = [x.schema["members"].dataType.elementType["id"].dataType.simpleString() for x in (packed, blocks)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part = row.column(0)[0].as_py()
                (asked, q), (ids, v) = _packed(row.column(1)), _packed(row.column(2))
                kth = row.column(3).flatten().to_pylist() if row.num_columns > 3 else [None] * len(q)
                rough = _distances(q, v)
                margin = 1e-6 * (1 + rough.max())
                probes, found, far = [], [], []
                for j in range(len(q)):
                    bound = min(np.partition(rough[j], k - 1)[k - 1] if len(v) > k else np.inf, np.inf if kth[j] is None else kth[j])
                    near = np.flatnonzero(rough[j] <= bound + margin)
                    exact = np.sqrt(((v[near] - q[j]) ** 2).sum(1))
                    best = np.argsort(exact, kind="stable")[:k]  # members are in the order of ids
                    probes += [j] * len(best)
                    found += near[best].tolist()
                    far += exact[best].tolist()
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(probes, pa.int64())), pa.array([part] * len(far), pa.string()), ids.take(pa.array(found, pa.int64())), pa.array(far, pa.float64())], ["probe_id", "part", "vec_id", "distance"])

    more = ["kth"] if "kth" in packed.columns else []
    mine = packed.select("pid", F.col("members").alias("asked"), *more)
    met = pairs.join(mine, "pid").join(blocks, ["part", "cell", "block"]).select("part", "asked", "members", *more)
    return met.mapInArrow(search, f"probe_id {kinds[0]}, part string, vec_id {kinds[1]}, distance double")


def nearest(vectors: DataFrame, probes: DataFrame, k: int, report: dict | None = None) -> DataFrame:
    """probe_id, part, vec_id, distance and rank (from 1) of the ``k`` nearest vectors (vec_id, embedding) of each probe (probe_id, probe).

    If both have a column ``part``, a probe finds vectors of its part. ``report`` takes the number of pairs of probe and vector that were compared.
    """
    spark: SparkSession = vectors.sparkSession
    lengths = [r[0] for r in probes.where("probe is not null").select(F.size("probe")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("probes must be of one length")
    part = lambda df: F.col("part").cast("string").alias("part") if "part" in df.columns else F.lit("").alias("part")
    length = lengths[0] if lengths else 0
    points = vectors.select("vec_id", part(vectors), finite(F.col("embedding"), length).alias("v")).where("v is not null")
    asked = probes.select(F.col("probe_id").alias("id"), part(probes), finite(F.col("probe"), length).alias("v")).where("v is not null")
    middle = spark.sparkContext.broadcast(centres(points))
    if not len(middle.value):
        none = points.select(F.col("vec_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
        return asked.select(F.col("id").alias("probe_id"), "part").join(none, F.lit(False)).select("probe_id", "part", "vec_id", "distance", "rank")
    stored, _ = keep(placed(points.withColumnRenamed("vec_id", "id"), middle))
    blocks, summary = packs(stored, BLOCK)
    blocks, _ = keep(blocks)
    asked, drop_asked = keep(placed(asked, middle))
    cells = summary.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("cell", "n", "radius", "blocks"))).alias("cells"))  # at most CENTRES a part
    packed = packs(asked, PACK)[0].select(F.monotonically_increasing_id().alias("pid"), "part", "members")
    small = summary.limit(SUMMARIES + 1).count() <= SUMMARIES
    packed, _ = keep(packed.join(F.broadcast(cells) if small else cells, "part"))
    drop_asked()
    first, _ = keep(_pairs(packed, middle, k, False))
    found, _ = keep(_searched(first, packed, blocks, k))
    own = Window.partitionBy("part", "probe_id").orderBy("distance", "vec_id")
    kth = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") == k).select("part", "probe_id", F.col("distance").alias("kth"))
    # Each pack's k-th distances in the order of its probes.
    each = packed.select("pid", "part", F.posexplode("members").alias("i", "m")).select("pid", "part", "i", F.col("m.id").alias("probe_id"))
    told = each.join(kth, ["part", "probe_id"], "left").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("i", "kth"))).alias("told"))
    bounded, _ = keep(packed.join(told.select("pid", F.transform("told", lambda x: x["kth"]).alias("kth")), "pid"))
    rest, _ = keep(_pairs(bounded, middle, k, True))
    more = _searched(rest, bounded, blocks, k)
    if report is not None:
        sizes = blocks.select("part", "cell", "block", F.size("members").alias("n"))
        met = first.union(rest).join(packed.select("pid", F.size("members").alias("q")), "pid").join(sizes, ["part", "cell", "block"])
        report["compared"] = met.agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0)).alias("n")).first().n
    return found.union(more).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("probe_id", "part", "vec_id", "distance", "rank")
