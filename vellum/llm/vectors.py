"""Exact top-k inner products, by elimination over a table of pivot distances.

Components become integers. Every vector's distances to many pivots are computed once. For a
query q and a row x, each pivot p gives |d(q,p) - d(x,p)| <= d(q,x); the greatest of these
bounds the inner product from above, since 2<q,x> = |q|^2 + |x|^2 - d(q,x)^2. Candidates are
evaluated in the order of their bounds, until the next bound is below the k-th
score so far: that is exact, ties included.

Rows are sorted into ranges by their nearest pivot and packed into blocks; a block's summary is the interval of its
distances to each pivot and its largest norm. Packs of blocks are the unit that is shipped:

1. Summaries alone, without vectors, tell for every query pack which row pack promises most; each query pack meets that one
   first, which gives every query a k-th score.
2. With these scores the summaries tell which other packs can still hold a better row; only those are shipped and evaluated, from the carried
   score on.

A final ranking per query merges both. Memory is bounded by the sizes of packs; a small table's packs are smaller, so that all cores have some. No window or task takes all queries or all rows of a
pivot: ranges go on by distance and id, so equal vectors are split too.

Null vectors, and vectors with a null or non-finite component, take no part. Vectors of each length are a space of their own: a
query meets the rows of its length. The ``LENGTHS`` most frequent lengths have pivots, of ``ELEMENTS`` components in all; in others, and where one vector is wider than its share, the origin stands for them, which bounds less
and costs no result. Null ids take no part. Repeated rows are candidates of their own; a
query skips all rows of its own id, and repeated queries share one ranking. Ties go to the smaller id. Empty arrays score 0; a score beyond a long is an error. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, keep

#: Vectors of a block at least and at most, blocks of a pack, pivots a length, and lengths with pivots and their components (they pass through the driver, 64 MB at most).
LEAST, BLOCK, PACK, PIVOTS, LENGTHS, ELEMENTS = 16, 512, 16, 64, 1000, 8_000_000
#: Summaries of either side that are compared at a time.
QUERY_SIDE, ROW_SIDE = 64, 2048
PLACED = "vec_id long, width int, cell int, near double, vector binary, dist binary, asks boolean"
PACKED = "pack long, block long, width int, ids binary, vectors binary, dist binary, lo binary, hi binary, most double"
RESULT = "query_id long, rank int, vec_id long, score long"


def integers(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles that hold whole numbers."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def bounds(norm: np.ndarray, most: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Greatest inner products at squared norms and distances of at least ``apart``. Rounding may not cost a candidate: they are loosened by far more than it."""
    whole = norm + most
    return (whole - np.maximum(apart - 1e-6 * np.sqrt(whole) - 1e-3, 0) ** 2) / 2 + 1 + 1e-9 * whole


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles; beyond 2 ** 53 by Python's integers."""
    if (x**2).sum(1).max(initial=0) * (q @ q) < 2.0**106:
        return x @ q
    whole = [int(b) for b in q]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in x], object)


def tile(q_ids, q, q_dist, tau, x_ids, x, x_dist, k: int) -> tuple[list[tuple], int]:
    """The k best rows, of at least ``tau``, for each query: (query's place, row ids, scores), and the number of candidates evaluated."""
    found, evaluated = [], 0
    x_norm = (x**2).sum(1)
    for i in range(len(q)):
        upper = bounds(q[i] @ q[i], x_norm, np.abs(x_dist - q_dist[i]).max(1, initial=0))
        alive = np.flatnonzero(upper >= tau[i])
        order = alive[np.argsort(-upper[alive], kind="stable")]
        ids, scores, at, step = np.empty(0, np.int64), np.empty(0), 0, max(64, 4 * k)
        while at < len(order):
            if len(scores) >= k and upper[order[at]] < scores[-1]:
                break
            some = order[at : at + step]
            at, step, evaluated = at + step, step * 2, evaluated + len(some)
            some = some[x_ids[some] != q_ids[i]]
            value = products(x[some], q[i])
            good = value >= tau[i]
            ids, scores = np.concatenate([ids, x_ids[some][good]]), np.concatenate([scores, value[good]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        if len(ids):
            found.append((i, ids, scores))
    return found, evaluated


def _of(raw, width: int) -> np.ndarray:
    flat = np.frombuffer(raw, float)
    return flat.reshape(-1, width) if width else flat.reshape(0, 0)


def placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Each row (vec_id, embedding, asks) with its distances and its nearest pivot."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            for width in np.unique(sizes):
                at = np.flatnonzero(sizes == width)
                x = np.asarray(vectors.take(pa.array(at)).flatten(), float).reshape(len(at), width)
                dist = distances(x, pivots.get(int(width), np.zeros((1, width))))
                flat = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, dist)]
                cells = [pa.array(np.full(len(at), width, np.int32)), pa.array(dist.argmin(1).astype(np.int32)), pa.array(dist.min(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *cells, *flat, batch.column(2).take(pa.array(at))], [c.split()[0] for c in PLACED.split(", ")])

    return rows.select("vec_id", "embedding", "asks").mapInArrow(made, PLACED)


def packs(rows: DataFrame, block: int) -> DataFrame:
    """Placed rows in ranges of pivots, distances and ids, as blocks, of ``block`` at most, of packs."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def out() -> tuple:
            nonlocal number
            width = held[0][1]
            ids, x, dist = np.array([r[0] for r in held], np.int64), np.stack([np.frombuffer(r[2], float) for r in held]), np.stack([np.frombuffer(r[3], float) for r in held])
            number += 1
            held.clear()
            return number // PACK, number, width, ids.tobytes(), x.tobytes(), dist.tobytes(), dist.min(0).tobytes(), dist.max(0).tobytes(), float((x**2).sum(1).max())

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*done), kinds)], [c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (len(held) == block or held[0][1] != row[1]):
                    if held[0][1] != row[1]:
                        done = out()
                        number = (number // PACK + 1) * PACK  # a pack has one length
                    else:
                        done = out()
                    yield batch_of([done])
                held.append(row)
        if held:
            yield batch_of([out()])

    dealt = rows.repartitionByRange("width", "cell", "near", "vec_id").sortWithinPartitions("width", "cell", "near", "vec_id")
    return dealt.select("vec_id", "width", "vector", "dist").mapInArrow(made, PACKED)


def promising(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int) -> DataFrame:
    """q, x and bound of the query packs and row packs that can hold a row of a query's threshold (tau: binary, or null) or better, from summaries alone."""
    a, b = -(-n_queries // QUERY_SIDE), -(-n_rows // ROW_SIDE)
    mine = queries.select(F.lit(True).alias("query"), "pack", "width", "dist", "vectors", "tau", F.lit(None).cast("binary").alias("lo"), F.lit(None).cast("binary").alias("hi"), F.lit(0.0).alias("most"), F.pmod(F.xxhash64("block"), F.lit(a)).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long"))).alias("b"))
    none = F.lit(None).cast("binary")
    theirs = rows.select(F.lit(False).alias("query"), "pack", "width", none.alias("dist"), none.alias("vectors"), none.alias("tau"), "lo", "hi", "most", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a - 1).cast("long"))).alias("a"), F.pmod(F.xxhash64("block"), F.lit(b)).alias("b"))

    def compare(table: pa.Table) -> pa.Table:
        best: dict[tuple[int, int], float] = {}
        held = table.drop_columns(["a", "b"]).to_pylist()
        for width in {r["width"] for r in held}:
            blocks = [r for r in held if not r["query"] and r["width"] == width]
            if not blocks:
                continue
            pack, most = np.array([r["pack"] for r in blocks]), np.array([r["most"] for r in blocks])
            lo, hi = (np.stack([np.frombuffer(r[c], float) for r in blocks]) for c in ("lo", "hi"))
            for r in held:
                if not r["query"] or r["width"] != width:
                    continue
                dist = _of(r["dist"], lo.shape[1])
                norm = (_of(r["vectors"], width) ** 2).sum(1) if width else np.zeros(len(dist))
                tau = np.frombuffer(r["tau"], float) if r["tau"] is not None else np.full(len(dist), -np.inf)
                for j in range(len(dist)):
                    apart = np.maximum(np.maximum(lo - dist[j], dist[j] - hi).max(1), 0)
                    upper = bounds(norm[j], most, apart)
                    for x in np.flatnonzero(upper >= tau[j]):
                        key = (r["pack"], int(pack[x]))
                        best[key] = max(best.get(key, -np.inf), float(upper[x]))
        return pa.table({"q": pa.array([x[0] for x in best], pa.int64()), "x": pa.array([x[1] for x in best], pa.int64()), "bound": pa.array(list(best.values()), pa.float64())})

    return mine.unionByName(theirs).groupBy("a", "b").applyInArrow(compare, "q long, x long, bound double").groupBy("q", "x").agg(F.max("bound").alias("bound"))


def evaluated(pairs: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """block, i (a query's place), query_id, vec_id and score of the k best rows of each pair of packs (q, x)."""
    columns = ["block", "width", "ids", "vectors", "dist", "tau"]
    mine = pairs.join(queries.withColumnRenamed("pack", "q"), "q").select("q", "x", F.lit(True).alias("query"), *columns)
    theirs = pairs.join(rows.withColumnRenamed("pack", "x").withColumn("tau", F.lit(None).cast("binary")), "x").select("q", "x", F.lit(False).alias("query"), *columns)

    def best(table: pa.Table) -> pa.Table:
        held = table.drop_columns(["q", "x"]).to_pylist()
        out: list[tuple] = []
        blocks = [r for r in held if not r["query"]]
        for r in held:
            if r["query"] and blocks:
                width, ids = r["width"], np.frombuffer(r["ids"], np.int64)
                theirs = np.concatenate([np.frombuffer(y["ids"], np.int64) for y in blocks])
                side = lambda y, n: np.frombuffer(y["vectors"], float).reshape(n, width)
                x = np.concatenate([side(y, len(y["ids"]) // 8) for y in blocks])
                pivots = len(r["dist"]) // 8 // len(ids)
                x_dist = np.concatenate([_of(y["dist"], pivots) for y in blocks])
                tau = np.frombuffer(r["tau"], float) if r["tau"] is not None else np.full(len(ids), -np.inf)
                for i, found, scores in tile(ids, side(r, len(ids)), _of(r["dist"], pivots), tau, theirs, x, x_dist, k)[0]:
                    out += [(r["block"], i, int(ids[i]), int(v), int(s)) for v, s in zip(found, scores)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("block", "i", "query_id", "vec_id", "score"), zip(*out) if out else [()] * 5)})

    return mine.unionByName(theirs).groupBy("q", "x").applyInArrow(best, "block long, i long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows (vec_id, embedding) of each query."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.withColumn("embedding", integers(F.col("embedding"), scale))
    # Pivots: of each length, the rows with the smallest hashes; any pivots give right results.
    sized = rows.select("embedding", F.size("embedding").alias("width"), "vec_id", F.xxhash64("vec_id", F.lit(seed)).alias("h"))
    number: dict[int, int] = {}
    widths = dict(map(tuple, sized.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "width").limit(LENGTHS).collect()))
    if not widths:
        return vectors.sparkSession.createDataFrame([], RESULT)
    for width in widths:
        number[width] = min(PIVOTS, ELEMENTS // len(widths) // max(1, width))
    wanted = F.broadcast(vectors.sparkSession.createDataFrame(sorted(number.items()), "width int, most int"))  # at most LENGTHS
    first = sized.join(wanted, "width").withColumn("n", F.row_number().over(Window.partitionBy("width").orderBy("h", "vec_id"))).where((F.col("n") <= PIVOTS) & (F.col("n") <= F.col("most")))
    chosen: dict[int, list] = {}
    for r in first.select("width", "embedding").collect():  # at most ELEMENTS components
        chosen.setdefault(r.width, []).append(r.embedding)
    block = max(LEAST, min(BLOCK, sum(widths.values()) // (2 * PACK * vectors.sparkSession.sparkContext.defaultParallelism)))
    every, drop_every = keep(placed(rows, {w: np.array(x, float).reshape(len(x), w) for w, x in chosen.items()}))
    candidates, drop_candidates = keep(packs(every.drop("asks"), block))
    asked, drop_asked = keep(packs(every.where("asks").drop("asks"), BLOCK))
    drop_every()
    n_asked, n_rows = asked.count(), candidates.count()
    if not n_asked:
        return vectors.sparkSession.createDataFrame([], RESULT)
    summaries = candidates.select("pack", "block", "width", "lo", "hi", "most")
    blank = asked.withColumn("tau", F.lit(None).cast("binary"))
    begin = cut(promising(blank, summaries, n_asked, n_rows).groupBy("q").agg(F.max_by("x", F.struct("bound", "x")).alias("x")))
    early = cut(evaluated(begin, blank, candidates, k))
    reached = early.groupBy("block", "i").agg(F.min("score").alias("tau"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    known = reached.groupBy("block").agg(F.collect_list(F.struct("i", "tau")).alias("known"))
    carried, drop_carried = keep(_with_tau(asked.join(known, "block", "left")))
    more = promising(carried, summaries, n_asked, n_rows).select("q", "x").join(begin, ["q", "x"], "left_anti")
    late = cut(evaluated(cut(more), carried, candidates, k))
    for drop in (drop_candidates, drop_asked, drop_carried):
        drop()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return early.union(late).select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_tau(asked: DataFrame) -> DataFrame:
    """Query blocks with their queries' k-th scores so far, from ``known`` (array of i, tau)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taus = []
            for ids, known in zip(batch.column("ids"), batch.column("known").to_pylist()):
                tau = np.full(len(ids.as_buffer()) // 8, -np.inf)
                for x in known or ():
                    tau[x["i"]] = x["tau"]
                taus.append(tau.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(taus, pa.binary())], [*batch.schema.names[:-1], "tau"])

    columns = [c.split()[0] for c in PACKED.split(", ")]
    return asked.select(*columns, "known").mapInArrow(made, f"{PACKED}, tau binary")
