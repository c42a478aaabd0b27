"""Sharding by balanced label propagation: documents of equal text move together, while shards keep equal numbers of rows.

Equal texts are linked. As rows of a group can't be told apart until the end, a group is kept as its numbers of rows by shard, which pre-aggregates even a group that
holds a third of all rows into one row a shard:

1. Each document starts in a shard drawn from its number.
2. In a round, each shard's part of a linked group asks to move to the shard where most of its group is, of those with room, if that is more than its own. So each round cuts
   fewer links. Requests are ranked by links won, running sums over slices
   tell which of them fit their target, which may hold ``SLACK`` times its quota in the rounds, and at its border a part moves as far as it fits. Rounds end when none is granted, or after ``ROUNDS``.
3. The largest parts of a shard stay, up to its quota. What exceeds it, group by group, and then all documents without links fill the room that is left exactly; only what lies at a border of two rooms is split.
4. Documents are numbered within their group, and take shard and slot from their group's places in that order.

Quotas differ by one row at most, so the law is ``rows``. Running sums are made of sums of slices and of rows within a slice, and groups of more than a ``HOT``-th of all rows, fewer than ``HOT``, are
numbered by slices and joined by broadcast; so no task holds a group, a shard or all rows. The driver reads the shards' loads, 16 numbers a round.

A null text counts as empty: size 1, and linked to empty texts. Repeated rows are rows of a group. A very long text is read for its hash only. An empty table gives no
rows. Extra columns are ignored, whatever their names. Reruns over the same partitions agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import keep

#: Rounds at most; a shard's rows in the rounds, over its quota; groups that may be broadcast; rows of a slice, about, and slices at least.
ROUNDS, SLACK, HOT, SLICE, SLICES = 40, 1.5, 1024, 200_000, 256


def running(rows: DataFrame, within: list[str], order: list[Column], weight: str, slices: int) -> DataFrame:
    """``rows`` (with ``hub``) with ``before``: the sum of ``weight`` ahead of each row among those of equal ``within``, in the order of the first of ``order``, of slices, and of the rest."""
    keys = [*within, "rank", "slice"]
    dealt = rows.withColumn("rank", order[0]).withColumn("slice", F.pmod(F.xxhash64("hub", F.lit(7)), F.lit(slices)).cast("int"))
    ahead = Window.partitionBy(*within).orderBy("rank", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys).agg(F.sum(weight).alias("total")).withColumn("start", F.coalesce(F.sum("total").over(ahead), F.lit(0))).drop("total")
    inside = Window.partitionBy(*keys).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return summed.join(starts, keys).withColumn("before", (F.col("start") + F.col("inside")).cast("long")).drop("rank", "slice", "start", "inside")


def pick(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (shard + 1).cast("int"))


def propagated(parts: DataFrame, quotas: list[int], slices: int) -> DataFrame:
    """``parts`` (hub, shard, n) of linked groups after all rounds, as a table."""
    limits = [int(q * SLACK) for q in quotas]
    parts, drop = keep(parts.withColumn("moved", F.lit(0).cast("long")))
    for turn in range(ROUNDS):
        told = parts.groupBy("shard").agg(F.sum("n"), F.sum("moved")).collect()  # a row a shard
        if not told or (turn and not any(moved for _, _, moved in told)):
            break
        loads = {s: n for s, n, _ in told}
        room = [max(0, limit - loads.get(s, 0)) for s, limit in enumerate(limits)]
        # Equal parts are told apart by hash, so that no shard is preferred.
        mine = F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")
        most = F.max(F.when(pick(room, F.col("shard")) > 0, mine)).over(Window.partitionBy("hub"))
        # Only a smaller part moves to a larger one: links won are more than links lost.
        asked = parts.withColumn("mine", mine).withColumn("most", most)
        asked = asked.select("hub", "shard", "n", F.when(F.col("mine") < F.col("most"), F.col("most")["shard"]).alias("target"), F.col("most")["n"].alias("won"))
        wants = running(asked.where("target is not null"), ["target"], [-F.ceil(F.log2(F.col("won") + 1)), F.col("hub"), F.col("shard")], "n", slices)
        wants = wants.withColumn("gone", F.greatest(F.lit(0), F.least(F.col("n"), pick(room, F.col("target")) - F.col("before"))).cast("long"))
        none = F.lit(0).cast("long").alias("moved")
        left = wants.select("hub", "shard", (F.col("n") - F.col("gone")).alias("n"), none)
        went = wants.select("hub", F.col("target").alias("shard"), F.col("gone").alias("n"), F.col("gone").alias("moved"))
        after = asked.where("target is null").select("hub", "shard", "n", none).union(left).union(went).where("n > 0")
        after, dropped = keep(after.groupBy("hub", "shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")))
        drop()
        parts, drop = after, dropped
    return parts.drop("moved")


def filled(parts: DataFrame, singles: DataFrame, quotas: list[int], slices: int) -> DataFrame:
    """Places (hub, shard, n) of all rows, exactly ``quotas`` of each shard: ``parts`` (hub, shard, n) up to it, the largest first, then what exceeds it and ``singles`` (hub, n)."""
    ranked = running(parts, ["shard"], [-F.ceil(F.log2("n")), F.col("hub")], "n", slices)
    quota = pick(quotas, F.col("shard"))
    fits = F.greatest(F.lit(0), F.least(F.col("n"), quota - F.col("before"))).cast("long")
    # A part at the border goes elsewhere whole, if it isn't a large share of its shard.
    stays = F.when((fits == F.col("n")) | (F.col("n") * F.lit(8) > quota), fits).otherwise(F.lit(0).cast("long"))
    ranked, _ = keep(ranked.select("hub", "shard", stays.alias("stays"), (F.col("n") - stays).alias("loose")))
    fixed = ranked.where("stays > 0").select("hub", "shard", F.col("stays").alias("n"))
    loads = dict(map(tuple, fixed.groupBy("shard").agg(F.sum("n")).collect()))
    bounds, upto = [], 0
    for s, q in enumerate(quotas):
        bounds.append((s, upto, upto + q - loads.get(s, 0)))
        upto = bounds[-1][2]
    loose = ranked.where("loose > 0").groupBy("hub").agg(F.sum("loose").alias("n"))
    # What is split lies at a border of rooms.
    items = running(loose.union(singles), [], [-F.ceil(F.log2("n")), F.col("hub")], "n", slices)
    rooms = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for s, a, b in bounds])
    here = lambda r: F.least(r["b"], F.col("before") + F.col("n")) - F.greatest(r["a"], F.col("before"))
    met = F.transform(F.filter(rooms, lambda r: here(r) > 0), lambda r: F.struct(r["shard"].alias("shard"), here(r).alias("n")))
    put = items.select("hub", F.explode(met).alias("p")).select("hub", "p.shard", "p.n")
    return fixed.union(put).groupBy("hub", "shard").agg(F.sum("n").alias("n"))


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of the documents (doc_id, text); see the module."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("hub"),
    )
    rows, _ = keep(rows)
    started = rows.groupBy("hub", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    started, drop_started = keep(started.withColumn("all", F.sum("n").over(Window.partitionBy("hub"))))  # a row a shard and group
    number = started.agg(F.sum("n")).first()[0] or 0
    slices = max(SLICES, number // SLICE)
    quotas = [number // shards + (s < number % shards) for s in range(shards)]
    linked = propagated(started.where("`all` > 1").select("hub", "shard", "n"), quotas, slices)
    places = filled(linked, started.where("`all` = 1").select("hub", "n"), quotas, slices)
    # Each place's first slot in its shard, and its first row in its group.
    slots = running(places, ["shard"], [F.lit(0), F.col("hub")], "n", slices).withColumnRenamed("before", "slot")
    first = F.coalesce(F.sum("n").over(Window.partitionBy("hub").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = slots.withColumn("first", first).groupBy("hub").agg(F.collect_list(F.struct("first", "shard", "slot")).alias("places"), F.sum("n").alias("rows"))  # a place a shard
    groups, _ = keep(groups.withColumn("hot", F.col("rows") * F.lit(HOT) > F.lit(number)))
    drop_started()
    hot = groups.where("hot")  # fewer than HOT
    named = rows.join(F.broadcast(hot.select("hub", F.lit(True).alias("hot"))), "hub", "left").withColumn("hot", F.col("hot").isNotNull())
    inside = F.row_number().over(Window.partitionBy("hub", "part").orderBy("rid")) - 1
    # Rows of hot groups are numbered part by part.
    parts = named.where("hot").withColumn("part", F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(slices)).cast("int"))
    counts = parts.groupBy("hub", "part").agg(F.count(F.lit(1)).alias("total"))
    counts = counts.select("hub", "part", (F.sum("total").over(Window.partitionBy("hub").orderBy("part")) - F.col("total")).alias("start"))
    heavy = parts.withColumn("nth", inside).join(counts, ["hub", "part"]).withColumn("nth", F.col("nth") + F.col("start")).join(F.broadcast(hot.select("hub", "places")), "hub")
    light = named.where("not hot").withColumn("part", F.lit(0)).withColumn("nth", inside).join(groups.where("not hot").select("hub", "places"), "hub")
    columns = ["doc_id", "size", "text_crc32", "nth", "places"]
    placed = heavy.select(columns).union(light.select(columns))
    # The last place that begins at or before the row.
    at = F.array_max(F.filter("places", lambda p: p["first"] <= F.col("nth")))
    placed = placed.withColumn("at", at)
    slot = (F.col("at")["slot"] + F.col("nth") - F.col("at")["first"]).cast("long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("at")["shard"].cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
