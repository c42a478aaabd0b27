"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Sources in code point order, null last, weigh ``weights`` in turn and share a
multiple of all sizes. A target stops at ``most`` times its source's size; the excess goes to the others by
weight until none is above. In closed form: sources in order of limit / weight, the level at which
the next one is not capped.

A document's key is exponential, scaled by its quality weight: -ln(u) / w, with u from
a hash of the document, so that reruns agree. A source first takes all of itself as
often as fits its target whole (epochs); the rest is filled in key order up to the exact
number of words: the document at the border counts with the words that still fit.

The running sum is distributed: keys are cut into slices of about equal count, slice
sums are accumulated per source, and only within a slice are rows
sorted. No task holds a source, however large; slices grow as the square root of the row count.

Null texts have size 0 and take 0. A null source is a source. Repeated rows are documents of
their own: they tie, and whichever is taken the rows are the same. An empty table gives no rows. A very long text is one row of its size. Extra columns are kept by ``mix``,
whatever their names, and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, unit_hash, word_count

#: Quality weights lie in [LEAST, 1].
LEAST = 0.25


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less with every symbol among the characters; at least ``LEAST``."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(F.translate(text, "#*$%&|<>!", ""))
    share = (F.length(text) - plain) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(LEAST), F.lit(1.0) - F.lit(5.0) * share)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with target. The number of sources is far below that of documents."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("rank", rank).withColumn("w", F.element_at(cycle, F.pmod("rank", F.lit(len(weights))).cast("int") + 1)).withColumn("limit", F.col("source_size") * F.lit(most))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    found = ranked.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("limit") / F.col("w"), F.struct(F.col("limit") / F.col("w"), "rank", "level"))).over(every)["level"])
    return found.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("w"), F.col("limit"))).alias("target"))


def drawn(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """``rows`` (doc_id, source, size and quality, and columns whose names don't start with ``mix_``) with source_size, target and taken; no row is lost.

    Read more than once: give it a table.
    """
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("mix_n"))
    total = cut(total)
    goal = targets(total.select("source", "source_size"), weights, share, most)
    number = total.agg(F.sum("mix_n")).first()[0] or 0
    slices = max(1, int(4 * number**0.5))
    key = -F.log(unit_hash(F.lit(seed), F.col("doc_id"), F.col("size"))) / F.col("quality")
    dealt = rows.withColumn("mix_key", key).withColumn("mix_slice", F.floor(F.lit(slices) * (F.lit(1.0) - F.exp(-F.col("mix_key") * F.lit(0.8)))).cast("int"))
    per_slice = dealt.groupBy("source", "mix_slice").agg(F.sum("size").alias("mix_sum"))
    starts = per_slice.select("source", "mix_slice", (F.sum("mix_sum").over(Window.partitionBy("source").orderBy("mix_slice")) - F.col("mix_sum")).alias("mix_start"))
    starts = starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "g.source_size", "g.target")
    within = Window.partitionBy("source", "mix_slice").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.alias("d").join(starts.alias("s"), (F.col("d.mix_slice") == F.col("s.mix_slice")) & F.col("d.source").eqNullSafe(F.col("s.source")))
    joined = joined.select("d.*", "s.source_size", "s.target", "s.mix_start")
    upto = F.col("mix_start") + F.sum("size").over(within) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("mix_before")))
    return joined.withColumn("mix_before", upto).withColumn("taken", taken.cast("long")).drop("mix_key", "mix_slice", "mix_start", "mix_before")


def sampled(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document (doc_id, source, text)."""
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("quality")))
    return drawn(rows, **how).drop("quality")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: each as often as it is taken; at the border of a budget, if at least half of it is.

    The counts come from narrow rows; texts are shuffled once, to meet their counts.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    # One of two equal rows may be taken once more than the other; each gets its share by number.
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), key.alias("digest")]
    same = docs.select(*keys, word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("quality"))
    counts = drawn(cut(same), **how).withColumn("times", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(0)))
    counts = counts.groupBy("doc_id", "source", "digest").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"))
    counts = counts.where("times > 0")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), *keys)
    on = (F.col("d.digest") == F.col("c.digest")) & F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source"))
    joined = keyed.alias("d").join(counts.alias("c"), on).select("d.*", "c.times", "c.rows")
    nth = F.when(F.col("rows") > 1, F.row_number().over(Window.partitionBy("doc_id", "source", "digest").orderBy("doc_id"))).otherwise(F.lit(1))
    times = F.expr("cast(times div rows + if(nth <= times % rows, 1, 0) as int)")
    return joined.withColumn("nth", nth).withColumn("times", times).where("times > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
