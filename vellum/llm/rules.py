"""Quality rules with adaptive thresholds.

Counts over words and lines of a text become a few rates. For each language and source,
a mergeable quantile sketch holds each rate's distribution: counts in buckets whose bounds grow by a
constant factor, so that any quantile is known within ``GROWTH - 1`` of itself, and adding counts
merges sketches exactly, in any order. Equal texts count once, so that a text with very many copies doesn't set a group's limits.

A rate's limits are fences on either side, ``FENCE`` times the distance of the quartiles away from them. A group's quartiles are its sketch's,
drawn towards those of its language, and these towards those of all, as if ``PRIOR`` texts had their quartiles: the fewer texts, the more. The distance counts as at least
half of that of all texts. No constant stands in for a limit: a rate whose quartiles are all equal has none. Documents join
their group's limits, and one that breaks any is rejected, as is one
that fails the fixed base rules (too few words, too many repeated ones).

Only built-in functions are used. Null and empty texts have no words and fail the base. A null language or
source is a group like others. Rows are judged one by one, so repeated rows agree; an empty table
gives no rows. A long text is one row: its words and the hashes of its windows are held at a time, some tens of bytes a word.
Extra columns stay in ``passed`` and are ignored elsewhere, whatever their names. A window of three words is known by 64 bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import SPACE, cut, let

#: Growth of the sketch's buckets, and what lies in the first of them.
GROWTH, LEAST = 1.01, 1e-4
FENCE, PRIOR = 4.0, 50
#: Shares that are judged: code points a word; other than letters and digits, and capitals, of a text's characters; words of at most 3 characters.
RATES = ("word_size", "marks", "capitals", "short")
#: Groups up to this number are broadcast with their limits (some hundred bytes each); more are joined by group and salt.
SMALL, SALTS = 20_000, 64


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that a text holds at least twice."""

    def twice(s: Column) -> Column:
        # Beyond the ends, try_element_at and the null-safe comparison say no.
        return F.filter(s, lambda x, k: F.try_element_at(s, k + 2)["w"].eqNullSafe(x["w"]) | ((k > 0) & F.try_element_at(s, F.greatest(k, F.lit(1)))["w"].eqNullSafe(x["w"])))

    def covered(at: Column) -> Column:
        after = lambda i, k: F.coalesce(F.try_element_at(at, k + 2) - i, F.lit(3))
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), after(i, k))), F.lit(0), lambda a, b: a + b)

    def counted(h: Column) -> Column:
        numbered = F.transform(h, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
        some = let(F.sort_array(numbered), lambda s: let(F.sort_array(F.transform(twice(s), lambda x: x["i"])), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some)  # most texts repeat none

    hashed = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(hashed(h), counted)))


def counts(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_capitals and n_short of a text, as a struct."""
    lacks = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def made(words: Column) -> Column:
        return let(
            lines,
            lambda kept: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                lacks("#*$%&|<>").cast("long").alias("n_symbols"),
                (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
                _repeated(words).cast("long").alias("n_repeat_words"),
                F.length(F.regexp_replace(text, r"[\p{L}\p{N}\x20\x09-\x0D]+", "")).cast("long").alias("n_marks"),
                F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
                F.size(F.filter(words, lambda w: F.length(w) <= 3)).cast("long").alias("n_short"),
            ),
        )

    return let(F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != ""), made)


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """doc (a struct of ``columns``), lang, source, digest (of the text), counts, base (does it fail the base) and rates of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    c = lambda name: F.col(f"counts.{name}")
    per = lambda a, b: (c(a) / F.greatest(c(b), F.lit(1))).cast("double")
    rates = {"word_size": per("word_chars", "n_words"), "marks": per("n_marks", "word_chars"), "capitals": per("n_capitals", "word_chars"), "short": per("n_short", "n_words")}
    base = (c("n_words") < 50) | (F.lit(100) * c("n_repeat_words") > F.lit(50) * c("n_words"))
    rows = docs.select(F.struct(*columns).alias("doc"), "lang", "source", F.xxhash64(text).alias("digest"), counts(text).alias("counts"))
    return rows.withColumns({"base": base, "rates": F.struct(*[rates[k].alias(k) for k in RATES])})


def limits(rows: DataFrame) -> DataFrame:
    """lang, source and limits (rate: low and high), from rows (lang, source, digest, base, rates). Base failures don't count."""
    bucket = lambda v: F.when(v < LEAST, F.lit(-1000)).otherwise(F.ceil(F.log(v) / F.lit(math.log(GROWTH)))).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), bucket(F.col(f"rates.{k}")).alias("bucket")) for k in RATES]))
    texts = rows.where(~F.col("base")).select("lang", "source", "digest", "rates").dropDuplicates(["lang", "source", "digest"])
    sketch = cut(texts.select("lang", "source", each.alias("e")).groupBy("lang", "source", "e.rate", "e.bucket").agg(F.count(F.lit(1)).alias("n")))

    def quartiles(*keys: str) -> DataFrame:
        """q1, q3 and n (texts) of the sketches merged by ``keys`` and rate."""
        own = Window.partitionBy(*keys, "rate")
        merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
        merged = merged.withColumn("upto", F.sum("n").over(own.orderBy("bucket"))).withColumn("all", F.sum("n").over(own))
        value = F.when(F.col("bucket") == -1000, F.lit(0.0)).otherwise(F.exp(F.col("bucket") * F.lit(math.log(GROWTH))))
        at = lambda p: F.min(F.when(F.col("upto") >= F.col("all") * F.lit(p), value))
        return merged.groupBy(*keys, "rate").agg(F.struct(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("all").alias("n")).alias(f"of_{len(keys)}"))

    found = quartiles("lang", "source").alias("o").join(quartiles("lang").alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.rate") == F.col("l.rate"))).select("o.*", "l.of_1").join(quartiles(), "rate")

    def drawn(q: str, level: int) -> Column:
        """A quartile of a group (2) or language (1), drawn towards the level above."""
        above = drawn(q, level - 1) if level > 1 else F.col(f"of_0.{q}")
        share = F.col(f"of_{level}.n") / (F.col(f"of_{level}.n") + F.lit(PRIOR))
        return share * F.col(f"of_{level}.{q}") + (F.lit(1.0) - share) * above

    found = found.select("lang", "source", "rate", drawn("q1", 2).alias("q1"), drawn("q3", 2).alias("q3"), ((F.col("of_0.q3") - F.col("of_0.q1")) / 2).alias("least"))
    apart = F.lit(FENCE) * F.greatest(F.col("q3") - F.col("q1"), F.col("least"))
    fences = F.when(apart > 0, F.struct((F.col("q1") - apart).alias("low"), (F.col("q3") + apart).alias("high")))
    return found.select("lang", "source", "rate", fences.alias("fences")).groupBy("lang", "source").agg(F.struct(*[F.max(F.when(F.col("rate") == k, F.col("fences"))).alias(k) for k in RATES]).alias("limits"))


def judged(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Measured rows with kept. A group without limits (all of it failed the base) has none to break."""
    bounds = cut(bounds)
    on = F.col("d.lang").eqNullSafe(F.col("b.lang")) & F.col("d.source").eqNullSafe(F.col("b.source"))
    if bounds.count() <= SMALL:
        found = F.broadcast(bounds)
    else:  # a group may hold most rows
        rows, found = rows.withColumn("salt", F.pmod("digest", F.lit(SALTS))), bounds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = on & (F.col("d.salt") == F.col("b.salt"))
    joined = rows.alias("d").join(found.alias("b"), on, "left").select("d.*", "b.limits")
    broken = F.lit(False)
    for k in RATES:
        broken = broken | F.coalesce((F.col(f"rates.{k}") < F.col(f"limits.{k}.low")) | (F.col(f"rates.{k}") > F.col(f"limits.{k}.high")), F.lit(False))
    return joined.withColumn("kept", ~F.col("base") & ~broken)


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document (doc_id, text, lang, source)."""
    rows = cut(measured(docs, "doc_id"))
    named = [f"counts.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(rows, limits(rows)).select(F.col("doc.doc_id").cast("long").alias("doc_id"), *named, F.col("base").alias("base_failed"), "kept")


def passed(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. Rates are computed once, into a table beside the texts, which aren't shuffled."""
    rows = cut(measured(docs, *docs.columns))
    return judged(rows, limits(rows)).where("kept").select("doc.*")
