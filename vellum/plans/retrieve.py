"""Retrieval: filter steps, exact rows and nearest vectors of each, dedupe, scores, and re-ranking.

For one question, all steps share one scan: a chunk is kept if any step takes it, and top rows of each step come from
group-limited windows, which cut rows within tasks before the shuffle.

For a table of questions, steps are rows. Questions repeat conditions, so each different condition is matched once, by an equi-join on one of its values; its exact rows are shared by all questions that have
it, and its matches are a part of the search by cells. Equal vectors of a condition are searched once.

Texts don't travel to pairs: questions meet them in packs, those of a condition its first rows, and those of a dense hit its chunk. A term is looked up once a pack and text.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import cells, retrieval, store
from vellum.plans import catalog, intent
from vellum.sources.shared import keep

# Fixed values.
LIST_TYPES = ("program_requirement_list", "schedule_course_list", "graduation_requirement_course_list")
CANDIDATES, RERANKED, LEAST_EXACT, LEAST_DENSE, KEY_CHARS = 20, 6, 12, 8, 80
#: Questions of a pack, and rows of a table that may be broadcast.
PACK, SMALL = 2048, 50_000
#: Questions that are re-ranked at once, and pairs of them with chunks.
TURNS, PAIRS = 512, 100_000
#: Parts of a text's words that are looked up rather than one term is searched for in the text.
PARTS = 20

COLUMNS = {**catalog.METADATA, "document_type": "string", "documentType": "string", "source_collection": "string", "source": "string"}


def asked(spark: SparkSession, question: str) -> dict:
    """What a question names: course_ids, terms, programs, requirements, types, collection, graduation."""
    q = F.lit(question)
    row = spark.range(1).select(
        intent.course_ids(q).alias("course_ids"), intent.term_codes(q).alias("terms"), intent.programs(q).alias("programs"), intent.requirement_types(q).alias("requirements"),
        intent.document_types(q).alias("types"), intent.source_collection(q).alias("collection"), intent.is_graduation(q).alias("graduation"),
    )
    return row.first().asDict()


def steps(found: dict, route: dict[str, object] | None = None) -> list[dict[str, object]]:
    """Conditions in the order in which they are tried, each with the route's."""
    named = {"source_collection": found["collection"], "document_type": found["types"], "term_code": found["terms"], "program": found["programs"]}
    loose = {k: v for k, v in named.items() if v}
    base = loose | ({"requirement_type": found["requirements"]} if found["requirements"] else {})
    out: list[dict[str, object]] = []
    for course in found["course_ids"]:
        out.append(base | {"course_id": course})
        if found["requirements"]:
            out.append(loose | {"course_id": course})
    if base:
        if not found["course_ids"] and set(LIST_TYPES) & set(found["types"]):
            out.append(base | {"aggregate": True})
        out.append(base)
    return [(route or {}) | s for s in out] or ([route] if route else [])


def retrieve(chunks: DataFrame, question: str, vector: list[float], k: int = CANDIDATES, route: dict[str, object] | None = None) -> DataFrame:
    """The ``k`` best chunks (chunk_id, text, embedding and metadata; absent columns count as null), with score and rank from 1.

    Each step gives its first max(3k, 12) rows by chunk_id and its max(k, 8) nearest; without any, the nearest of the route (or of all).
    Chunks without a vector are only found exactly; empty texts only by vector. Ties keep the order of arrival.
    """
    spark = chunks.sparkSession
    found = asked(spark, question)
    rows = chunks.withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in chunks.columns})
    tried = steps(found, route)
    probe = F.array(*[F.lit(float(x)) for x in vector])

    def nearest(conditions: list[dict[str, object]], n: int) -> DataFrame:
        near = rows.where(F.col("embedding").isNotNull()).withColumn("distance", retrieval.l2(F.col("embedding"), probe))
        return _branches(near, conditions, n, ["distance", "chunk_id"]).drop("distance")

    hits = None
    if tried:
        exact = _branches(rows.where(F.coalesce("text", F.lit("")) != ""), tried, max(3 * k, LEAST_EXACT), ["chunk_id"])
        hits = exact.withColumn("way", F.lit(0)).unionByName(nearest(tried, max(k, LEAST_DENSE)).withColumn("way", F.lit(1)))
        if hits.limit(1).isEmpty():
            hits = None
    if hits is None:
        hits = nearest([route or {}], k).withColumn("way", F.lit(1))
    key = F.coalesce("chunk_id", F.concat_ws("\x1f", F.coalesce("source", F.lit("")), F.substring("text", 1, KEY_CHARS)))
    single = store.first_per_key(hits, [key], ["branch", "way", "position"])
    score = F.round(scores(found) + retrieval.lexical_score(F.lit(question), F.coalesce("text", F.lit(""))), 6)
    best = single.withColumn("score", score).orderBy(F.col("score").desc(), "branch", "way", "position").limit(max(k, 1))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "branch", "way", "position")))
    return ranked.select(*chunks.columns, "score", "rank")


#: A condition of a step: values of which a chunk's must be one, or null.
CONDITION = "course string, requirements array<string>, types array<string>, terms array<string>, programs array<string>, collection string, aggregate boolean, route string"
_SETS = {"types": "document_type", "terms": "term_code", "programs": "program", "requirements": "requirement_type"}
_SINGLE = {"course": "course_id", "collection": "source_collection", "route": "documentType"}
#: Values by which conditions meet chunks, the most selective first.
_KEYS = ("course", "programs", "terms", "types", "requirements", "route", "collection")


def _steps(route: Column) -> Column:
    """The steps of a row (courses, terms, programs, requirements, types, collection) in order, as conditions; the route's alone if there are none."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    no_text, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def step(course: Column = no_text, requirements: Column | None = None, aggregate: bool = False) -> Column:
        fields = [course, some("requirements") if requirements is None else requirements, some("types"), some("terms"), some("programs"), F.nullif("collection", F.lit("")), F.when(F.lit(aggregate), F.lit(True)), route]
        return F.struct(*fields).cast(f"struct<{CONDITION.replace(' ', ':').replace(',:', ',')}>")

    listed = F.size(F.array_intersect("types", F.array(*[F.lit(t) for t in LIST_TYPES]))) > 0
    base = (F.size("types") + F.size("terms") + F.size("programs") + F.size("requirements") > 0) | (F.col("collection") != "")
    course = F.flatten(F.transform("courses", lambda c: F.array_compact(F.array(step(c), F.when(F.size("requirements") > 0, step(c, no_list))))))
    rest = F.array_compact(F.array(F.when(base & (F.size("courses") == 0) & listed, step(aggregate=True)), F.when(base, step())))
    every = F.concat(course, rest)
    only = F.array(F.struct(no_text, no_list, no_list, no_list, no_list, no_text, F.lit(None).cast("boolean"), route).cast(f"struct<{CONDITION.replace(' ', ':').replace(',:', ',')}>"))
    return F.when((F.size(every) == 0) & route.isNotNull(), only).otherwise(every)


def matches(chunks: DataFrame, conditions: DataFrame) -> DataFrame:
    """condition and chunk_id of all chunks (with ``COLUMNS``) that fulfil a condition (condition, c): an equi-join on its most selective value, then the others."""
    value = lambda name: F.col("c")[name] if name in _SETS else F.when(F.col("c")[name].isNotNull(), F.array(F.col("c")[name]))
    told = lambda name: lambda v: F.concat(F.lit(name + "="), v)
    keyed = F.coalesce(*[F.transform(value(n), told(n)) for n in _KEYS])
    asked = conditions.select("condition", "c", F.explode(F.array_distinct(keyed)).alias("key"))
    names = _SETS | _SINGLE
    rows = chunks.select("chunk_id", "aggregate", *names.values(), F.explode(F.array_compact(F.array(*[told(n)(F.col(names[n])) for n in _KEYS]))).alias("key"))
    fits = F.lit(True)
    for name, column in names.items():
        held = F.array_contains(F.col("c")[name], F.col(column)) if name in _SETS else F.col("c")[name] == F.col(column)
        fits = fits & (F.col("c")[name].isNull() | F.coalesce(held, F.lit(False)))
    fits = fits & (F.col("c")["aggregate"].isNull() | F.coalesce(F.col("aggregate"), F.lit(False)))
    return rows.join(asked, "key").where(fits).select("condition", "chunk_id")


def named(questions: DataFrame) -> DataFrame:
    """``questions`` with what each names."""
    q = F.coalesce("question", F.lit(""))
    return questions.withColumns({
        "courses": intent.course_ids(q), "terms": intent.term_codes(q), "programs": intent.programs(q), "requirements": intent.requirement_types(q), "types": intent.document_types(q),
        "collection": intent.source_collection(q), "graduation": intent.is_graduation(q), "words": retrieval.terms(q),
    })


def retrieve_many(chunks: DataFrame, questions: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """For each of the questions (question_id, question, vector; route, a documentType, may be absent): chunk_id, score and rank of its ``k`` best chunks, as `retrieve` finds them.

    chunk_id is unique and not null. The driver reads no question and no hit.
    """
    rows = chunks.withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in chunks.columns})
    route = F.col("route") if "route" in questions.columns else F.lit(None).cast("string")
    found = named(questions.select("question_id", "question", "vector", route.alias("route")))
    found, _ = keep(found.withColumns({"tags": retrieval.tags(), "told": F.array_join("words", " "), "same": F.md5(F.to_json(F.struct("vector")))}))
    tried = found.select("question_id", "same", "route", F.posexplode(_steps(F.col("route"))).alias("branch", "c"))
    tried, _ = keep(tried.withColumn("condition", F.md5(F.to_json("c"))))
    conditions = tried.groupBy("condition").agg(F.first("c").alias("c"))  # of equal ones
    hits, _ = keep(matches(rows, conditions))
    vectors = rows.where("embedding is not null").select("chunk_id", F.col("embedding"))

    # Exact: the first rows of each condition, for all steps that have it.
    texts = rows.where(F.coalesce("text", F.lit("")) != "").select("chunk_id")
    first = Window.partitionBy("condition").orderBy("chunk_id")
    exact, _ = keep(hits.join(texts, "chunk_id").withColumn("position", F.row_number().over(first)).where(F.col("position") <= max(3 * k, LEAST_EXACT)))

    def dense(asked: DataFrame, points: DataFrame, n: int) -> DataFrame:
        """Hits of ``asked`` (question_id, branch, same, part) among ``points`` (chunk_id, embedding, part)."""
        probes, _ = keep(asked.select("part", "same").distinct().join(found.groupBy("same").agg(F.first("vector").alias("probe")), "same").withColumn("probe_id", F.monotonically_increasing_id()))
        near = cells.nearest(points.withColumnRenamed("chunk_id", "vec_id"), probes.select("probe_id", "probe", "part"), n)
        near = near.select("probe_id", F.col("vec_id").alias("chunk_id"), F.col("rank").alias("position")).join(probes.select("probe_id", "part", "same"), "probe_id")
        return asked.join(near, ["part", "same"]).select("question_id", "chunk_id", "branch", "position")

    points = hits.join(vectors, "chunk_id").withColumnRenamed("condition", "part")
    stepped, _ = keep(dense(tried.withColumnRenamed("condition", "part"), points, max(k, LEAST_DENSE)))
    # Without a hit, a question takes the nearest of its route, or of all.
    with_hits = tried.join(exact.select("condition").distinct(), "condition", "left_semi").select("question_id").union(stepped.select("question_id"))
    left = found.join(with_hits, "question_id", "left_anti").select("question_id", F.lit(0).alias("branch"), "same", F.coalesce(F.concat(F.lit("="), "route"), F.lit("")).alias("part"))
    left, _ = keep(left)
    routes = left.select("part").distinct()
    routed = rows.where("embedding is not null").select("chunk_id", "embedding", F.explode(F.array_compact(F.array(F.lit(""), F.concat(F.lit("="), F.col("documentType"))))).alias("part"))
    every = stepped.union(dense(left, routed.join(routes, "part", "left_semi"), k)).repartition("question_id")
    near, _ = keep(every.groupBy("question_id", "chunk_id").agg(F.min(F.struct("branch", "position")).alias("at")).select("question_id", "chunk_id", "at.*"))

    ids, _ = keep(exact.select("chunk_id").union(near.select("chunk_id")).distinct())
    told, _ = keep(rows.join(_near(ids), "chunk_id", "left_semi").select("chunk_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), retrieval.worths().alias("worths")))
    asked = found.select("question_id", "told", "tags")
    shared = exact.join(told, "chunk_id").groupBy("condition").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "text", "worths"))).alias("texts"))  # at most max(3k, 12)
    stepping = tried.join(asked, "question_id").select(F.col("condition").alias("block"), "question_id", "branch", F.lit(0).alias("position"), "told", "tags")
    whole = _scored(stepping, shared.withColumnRenamed("condition", "block"), max(k, 1)).withColumn("way", F.lit(0))
    meeting = near.join(asked, "question_id").select(F.col("chunk_id").alias("block"), "question_id", "branch", "position", "told", "tags")
    single = told.select(F.col("chunk_id").alias("block"), F.array(F.struct(F.lit(0).alias("position"), "chunk_id", "text", "worths")).alias("texts"))
    whole = whole.unionByName(_scored(meeting, single, 1).withColumn("way", F.lit(1))).repartition("question_id")
    best = whole.groupBy("question_id", "chunk_id").agg(F.min(F.struct("branch", "way", "position")).alias("at"), F.first("score").alias("score"))  # a pair's scores are equal
    own = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "at")
    return best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= max(k, 1)).select("question_id", "chunk_id", "score", "rank")


def _near(ids: DataFrame) -> DataFrame:
    """A stored table of ids or counts, to be broadcast if it is small."""
    return F.broadcast(ids) if ids.limit(SMALL + 1).count() <= SMALL else ids


def _scored(asked: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """question_id, chunk_id, branch, position and score of the ``k`` best texts of each row of ``asked`` (block, question_id, branch, position, told, tags) among its block's (block, texts).

    A row's place is the sum of its position and the text's. What isn't among a row's ``k`` best isn't among the question's where this is its first place: others with as good a score and an earlier place are ``k`` already.
    """
    number, _ = keep(asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs")))
    dealt = asked.join(_near(number), "block").groupBy("block", F.pmod(F.xxhash64("question_id"), "packs").alias("pack"))
    packed = dealt.agg(F.collect_list(F.struct("question_id", "branch", "position", "told", "tags")).alias("asked"))  # some PACK
    ids = [asked.schema["question_id"].dataType.simpleString(), texts.schema["texts"].dataType.elementType["chunk_id"].dataType.simpleString()]
    return packed.join(texts, "block").select("asked", "texts").mapInArrow(_scorer(k), f"question_id {ids[0]}, chunk_id {ids[1]}, branch int, position int, score double")


def _held(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different texts of a column of lists; for each element the number of its row and of its text."""
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), coded.indices.to_numpy()


def _lookup(terms: list[str]) -> Callable[[str], np.ndarray]:
    """For a lower text, 1.0 for each of the different ``terms`` that it holds. A term is letters and digits, so it lies within a run of them; the empty one doesn't count.

    All parts of a run are looked up among the terms, those of a run once, unless a text has many more parts than there are terms.
    """
    place, longest, known = {t: i for i, t in enumerate(terms) if t}, max(map(len, terms), default=0), {}

    def within(run: str) -> set[int]:
        parts = (run[i:j] for i in range(len(run)) for j in range(i + 1, min(len(run), i + longest) + 1))
        return {place[x] for x in parts if x in place}

    def look(text: str) -> np.ndarray:
        held, runs = np.zeros(len(terms)), set(re.findall("[a-z0-9]+", text))
        fresh = [x for x in runs if x not in known]
        if sum(len(x) * min(len(x), longest) for x in fresh) <= PARTS * len(terms):
            known.update((x, within(x)) for x in fresh)
            held[list(set().union(*(known[x] for x in runs)))] = 1
        else:
            every = " ".join(runs)
            held[[i for t, i in place.items() if t in every]] = 1
        return held

    return look


def _scorer(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                asked, found = row.column(0).flatten(), row.column(1).flatten()
                ids, branch, position, told, tags = (asked.field(j) for j in range(5))
                terms, term_row, term = _held(pc.split_pattern(told, " "))
                names, tag_row, tag = _held(tags)
                at = {name: np.unique(tag_row[tag == j]) for j, name in enumerate(names)}
                scores, look = np.zeros((len(found), len(asked))), _lookup(terms)
                for j, (text, worths) in enumerate(zip(found.field(2).to_pylist(), found.field(3).to_pylist())):
                    scores[j] = 0.25 * np.bincount(term_row, look(text)[term], len(asked))
                    for w in worths:
                        if w["tag"] in at:
                            scores[j, at[w["tag"]]] += w["weight"]
                best = np.argsort(-scores, axis=0, kind="stable")[:k]  # texts are in the order of their places
                text, mine = best.T.ravel(), np.repeat(np.arange(len(asked)), len(best))
                place = position.to_numpy()[mine] + found.field(0).to_numpy()[text]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine)), found.field(1).take(pa.array(text)), branch.take(pa.array(mine)), pa.array(place, pa.int32()), pa.array(scores[text, mine])], ["question_id", "chunk_id", "branch", "position", "score"])

    return score


def _branches(rows: DataFrame, conditions: list[dict[str, object]], n: int, order: list[str]) -> DataFrame:
    each = [retrieval.conjunction(c) for c in conditions]
    return retrieval.ladder(rows.where(functools.reduce(operator.or_, each)), each, n, order)


def scores(found: dict) -> Column:
    c = F.col
    return retrieval.structured_score(c("course_id"), c("term_code"), c("program"), c("requirement_type"), c("source_authority"), c("aggregate"), found)


def retrieve_types(chunks: DataFrame, question: str, vector: list[float], types: list[str], k: int = CANDIDATES) -> DataFrame:
    """``k`` chunks of each document type, appended in the types' order and deduplicated; position from 0."""
    parts = [retrieve(chunks, question, vector, k, {"documentType": t}).withColumn("part", F.lit(i)) for i, t in enumerate(types)]
    every = functools.reduce(DataFrame.unionByName, parts)
    source = F.col("source") if "source" in chunks.columns else F.lit(None).cast("string")
    key = F.coalesce("chunk_id", F.concat_ws("\x1f", F.coalesce(source, F.lit("")), F.substring("text", 1, 120)))
    single = store.first_per_key(every, [key], ["part", "rank"])
    return single.withColumn("position", F.row_number().over(Window.orderBy("part", "rank")) - 1).drop("part", "rank")


def rerank(candidates: DataFrame, question: str, scorer: Column, k: int = RERANKED, arrival: str = "rank") -> DataFrame:
    """The ``k`` best by the scorer (any Column, a model's pandas UDF or built-ins) plus the metadata's score."""
    rows = candidates.withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in candidates.columns})
    both = rows.withColumn("rerank_score", scorer.cast("double")).withColumn("combined_rerank_score", F.col("rerank_score") + scores(asked(candidates.sparkSession, question)))
    best = both.orderBy(F.col("combined_rerank_score").desc(), arrival).limit(k)
    return best.select(*candidates.columns, "rerank_score", "combined_rerank_score")


def rerank_many(chunks: DataFrame, questions: DataFrame, found: DataFrame, k: int = RERANKED, blend: float = 1.0) -> DataFrame:
    """The ``k`` best of each question's candidates (of `retrieve_many`) by late interaction plus ``blend`` times the metadata's score: question_id, chunk_id, rerank_score, combined_rerank_score and rank.

    Questions meet the chunks in packs, and two tokens of a pack and its chunks are compared once; texts travel once a pack.
    """
    rows = chunks.withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS.items() if c not in chunks.columns})
    said = lambda text: F.array_join(retrieval.tokens(F.coalesce(text, F.lit(""))), " ")
    asked, _ = keep(named(questions.select("question_id", "question")).select("question_id", said("question").alias("told"), retrieval.tags().alias("tags")))
    number = max(1, -(-asked.count() // TURNS))
    pack = F.pmod(F.xxhash64("question_id"), F.lit(number)).alias("pack")
    found = found.select("question_id", "chunk_id", F.col("rank").alias("arrival"), pack)
    blocks, _ = keep(found.groupBy("pack").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("blocks")))
    dealt = found.join(_near(blocks), "pack").groupBy("pack", F.pmod(F.xxhash64("chunk_id"), "blocks").alias("block"), "chunk_id").agg(F.collect_list(F.struct("question_id", "arrival")).alias("pairs"))
    told = rows.select("chunk_id", said("text").alias("told"), retrieval.worths().alias("worths"))
    each = dealt.join(told, "chunk_id").groupBy("pack", "block").agg(F.collect_list(F.struct("chunk_id", "told", "worths", "pairs")).alias("found"))  # some PAIRS
    packed = asked.groupBy(pack).agg(F.collect_list(F.struct("question_id", "told", "tags")).alias("asked"))  # some TURNS
    met = each.join(packed, "pack").select("asked", "found").repartition(max(number, chunks.sparkSession.sparkContext.defaultParallelism))  # little to read, much to compute
    kinds = [found.schema[c].dataType.simpleString() for c in ("question_id", "chunk_id", "arrival")]
    scored = met.mapInArrow(_reranker(k, blend), f"question_id {kinds[0]}, chunk_id {kinds[1]}, arrival {kinds[2]}, score double, metadata double")
    scored = scored.withColumn("rerank_score", F.round("score", 6))
    both = scored.withColumn("combined_rerank_score", F.round(F.col("rerank_score") + F.lit(blend) * F.col("metadata"), 6))
    own = Window.partitionBy("question_id").orderBy(F.col("combined_rerank_score").desc(), "arrival")
    return both.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("question_id", "chunk_id", "rerank_score", "combined_rerank_score", "rank")


def _pieces(token: str) -> set[str]:
    marked = f"^{token}$"
    return {marked[i : i + 3] for i in range(len(token))}


def _cosines(terms: list[str]) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """For a token, those of ``terms`` that share a piece with it, and their cosines; each token is compared once."""
    sizes, holders, known = np.ones(len(terms)), {}, {}
    for i, term in enumerate(terms):
        pieces = _pieces(term)
        sizes[i] = max(1, len(pieces))
        for piece in pieces:
            holders.setdefault(piece, []).append(i)
    holders = {piece: np.array(at) for piece, at in holders.items()}

    def cosines(token: str) -> tuple[np.ndarray, np.ndarray]:
        if token not in known:
            pieces = _pieces(token)
            met = [holders[x] for x in pieces if x in holders]
            at, shared = np.unique(np.concatenate(met) if met else np.zeros(0, int), return_counts=True)
            known[token] = at, shared / np.sqrt(sizes[at] * len(pieces))
        return known[token]

    return cosines


def _reranker(k: int, blend: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                asked, found = row.column(0).flatten(), row.column(1).flatten()
                terms, term_row, term = _held(pc.split_pattern(asked.field(1), " "))
                names, tag_row, tag = _held(asked.field(2))
                at = {name: np.unique(tag_row[tag == j]) for j, name in enumerate(names)}
                cosines, sizes = _cosines(terms), np.maximum(1, np.bincount(term_row, minlength=len(asked)))
                pairs = found.field(3).flatten()
                chunk = np.repeat(np.arange(len(found)), pc.list_value_length(found.field(3)).to_numpy())
                turn = pc.fill_null(pc.index_in(pairs.field(0), value_set=asked.field(0)), -1).to_numpy()
                scores, metadata = np.zeros(len(pairs)), np.zeros(len(pairs))
                ends = np.searchsorted(chunk, np.arange(len(found) + 1))
                for j, (text, worths) in enumerate(zip(found.field(1).to_pylist(), found.field(2).to_pylist())):
                    best, own = np.zeros(len(terms)), np.zeros(len(asked))
                    for token in text.split():
                        met, near = cosines(token)
                        best[met] = np.maximum(best[met], near)
                    for w in worths:
                        if w["tag"] in at:
                            own[at[w["tag"]]] += w["weight"]
                    mine = slice(ends[j], ends[j + 1])
                    scores[mine] = (np.bincount(term_row, best[term], len(asked)) / sizes)[turn[mine]]  # summed in the order of tokens
                    metadata[mine] = own[turn[mine]]
                # Those that rounding may put among the k best.
                whole = scores + blend * metadata
                order = np.lexsort((-whole, turn))
                starts = np.searchsorted(turn[order], np.arange(len(asked)))
                ends = np.searchsorted(turn[order], np.arange(len(asked)), "right")
                least = np.full(len(asked), -np.inf)
                many = ends - starts > k
                least[many] = whole[order[starts[many] + k - 1]]
                kept = np.flatnonzero((turn >= 0) & (whole >= least[turn] - 4e-6))
                some = pa.array(kept)
                yield pa.RecordBatch.from_arrays([pairs.field(0).take(some), found.field(0).take(pa.array(chunk[kept])), pairs.field(1).take(some), pa.array(scores[kept]), pa.array(metadata[kept])], ["question_id", "chunk_id", "arrival", "score", "metadata"])

    return score
