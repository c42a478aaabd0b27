"""Dense, lexical and structured retrieval."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import cells

#: Probes up to this number, and of up to so many elements in all, are broadcast.
SMALL, ELEMENTS = 16, 200_000


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance, in the JVM and in doubles."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def dense_topk(vectors: DataFrame, probes: DataFrame, k: int, per: list[str] | None = None) -> DataFrame:
    """The ``k`` nearest rows (vec_id, embedding, ...) of each probe (probe_id, probe), or of each probe and ``per`` columns; rank from 1.

    A few probes (up to ``SMALL``, one of which an application asks at a time) are compared with each vector in one pass. More are searched by cells; ``per`` columns are parts then, and are told as such.
    """
    few = probes.limit(SMALL + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("probe")).alias("elements")).first()
    if few.n <= SMALL and (few.elements or 0) <= ELEMENTS:
        scored = vectors.join(F.broadcast(probes), F.lit(True)).withColumn("distance", l2(F.col("embedding"), F.col("probe")))
        own = Window.partitionBy("probe_id", *(per or [])).orderBy("distance", "vec_id")
        return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).drop("embedding", "probe")
    if per:
        told = F.to_json(F.struct(*per))
        vectors = vectors.withColumn("part", told)
        probes = probes.join(vectors.select("part").distinct(), F.lit(True))  # a probe a part, as asked
    found = cells.nearest(vectors, probes, k)
    rest = [c for c in vectors.columns if c not in ("embedding", "part")]
    return found.drop("part").join(vectors.select(rest), "vec_id")


def terms(query: Column) -> Column:
    """Distinct ASCII terms of more than one character."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 1))


def lexical_score(query: Column, text: Column, weight: float = 0.25) -> Column:
    return term_score(terms(query), text, weight)


def term_score(asked: Column, text: Column, weight: float = 0.25) -> Column:
    """``weight`` for each of the lower-case terms that the text holds; the text is lowered once."""
    return F.element_at(F.transform(F.array(F.lower(text)), lambda low: F.size(F.filter(asked, lambda t: F.contains(low, t)))), 1) * F.lit(weight)


def structured_score(course: Column, term: Column, program: Column, requirement: Column, authority: Column, aggregate: Column, asked: dict) -> Column:
    """Weights of matching metadata; ``asked``: course_ids, terms, programs, requirements (lists) and graduation (bool)."""
    worth = lambda c, values, w: F.when(c.isin(*values) if values else F.lit(False), F.lit(w)).otherwise(F.lit(0.0))
    graded = F.lit(asked["graduation"])
    return (
        worth(course, asked["course_ids"], 20.0) + worth(term, asked["terms"], 8.0) + worth(program, asked["programs"], 6.0) + worth(requirement, asked["requirements"], 4.0)
        + F.when(graded & (authority == "official_degree_evaluation"), 14.0).when(graded & (authority == "official_degree_requirements"), 6.0).otherwise(0.0)
        + F.when(F.coalesce(aggregate, F.lit(False)) & F.lit(not asked["course_ids"]), 1.0).otherwise(0.0)
    )


#: Metadata that a question's values may hold, and its weight.
WORTH = {"course_id": ("courses", 20.0), "term_code": ("terms", 8.0), "program": ("programs", 6.0), "requirement_type": ("requirements", 4.0)}


def structured_scores() -> Column:
    """`structured_score` where a row holds both a chunk's metadata and what its question asks (courses, terms, programs, requirements, graduation)."""
    worth = lambda c, asked, w: F.when(F.coalesce(F.array_contains(asked, F.col(c)), F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    graded, authority = F.col("graduation"), F.col("source_authority")
    return (
        functools.reduce(operator.add, [worth(c, asked, w) for c, (asked, w) in WORTH.items()])
        + F.when(graded & (authority == "official_degree_evaluation"), 14.0).when(graded & (authority == "official_degree_requirements"), 6.0).otherwise(0.0)
        + F.when(F.coalesce("aggregate", F.lit(False)) & (F.size("courses") == 0), 1.0).otherwise(0.0)
    )


def tags() -> Column:
    """What a question asks, as texts: `structured_scores` is the sum of a chunk's `worths` of which the question has the tag."""
    tagged = lambda c: lambda v: F.concat(F.lit(f"{c}="), v)
    named = [F.transform(asked, tagged(c)) for c, (asked, _) in WORTH.items()]
    rest = F.array(F.when(F.col("graduation"), F.lit("graduation")), F.when(F.size("courses") == 0, F.lit("no course")))
    return F.array_compact(F.concat(*named, rest))


def worths() -> Column:
    """A chunk's metadata as tags, each with its weight."""
    pair = lambda tag, w: F.struct(tag.alias("tag"), w.alias("weight"))
    named = [F.when(F.col(c).isNotNull(), pair(F.concat(F.lit(f"{c}="), F.col(c)), F.lit(w))) for c, (_, w) in WORTH.items()]
    graded = F.when(F.col("source_authority") == "official_degree_evaluation", 14.0).when(F.col("source_authority") == "official_degree_requirements", 6.0)
    return F.array_compact(F.array(*named, F.when(graded.isNotNull(), pair(F.lit("graduation"), graded)), F.when(F.col("aggregate"), pair(F.lit("no course"), F.lit(1.0)))))


def conjunction(parts: dict[str, object]) -> Column:
    """Equality or membership of each key; absent (null) values don't match. No parts match all."""
    each = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for k, v in parts.items()]
    return functools.reduce(operator.and_, each, F.lit(True))


def ladder(rows: DataFrame, steps: list[Column], limit: int, order: list[str]) -> DataFrame:
    """Rows of each filter step in one scan, with branch (from 0) and position, at most ``limit`` a branch."""
    branches = F.array_compact(F.array(*[F.when(F.coalesce(s, F.lit(False)), F.lit(i)) for i, s in enumerate(steps)]))
    spread = rows.withColumn("branch", F.explode(branches))
    return spread.withColumn("position", F.row_number().over(Window.partitionBy("branch").orderBy(*order))).where(F.col("position") <= limit)


def token_vectors(text: Column, most: int | None = None) -> Column:
    """The distinct tokens of a text as vectors, each the set of three-letter pieces of the token between its marks of beginning and end; the first ``most`` of them."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    found = F.slice(found, 1, most) if most else found
    pieces = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(F.concat(F.lit("^"), t, F.lit("$")), i, F.lit(3)))
    return F.transform(found, lambda t: F.array_distinct(pieces(t)))


def tokens(text: Column) -> Column:
    """The distinct tokens of a text, of which `token_vectors` makes vectors."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def late_interaction(question: Column, text: Column) -> Column:
    """Mean over the question's token vectors of the greatest cosine with any of the text's (both columns of `token_vectors`); 0 if either has none."""
    cosine = lambda a, b: F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b).cast("double"))
    best = F.transform(question, lambda a: F.coalesce(F.array_max(F.transform(text, lambda b: cosine(a, b))), F.lit(0.0)))
    return F.coalesce(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(question), F.lit(0)), F.lit(0.0))


def rerank(candidates: DataFrame, score: Column, k: int, arrival: list[str]) -> DataFrame:
    """The ``k`` best by score; ties keep the order of arrival."""
    scored = candidates.withColumn("score", score)
    return scored.orderBy(F.col("score").desc(), *arrival).limit(k)
