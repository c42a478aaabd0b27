"""Intent: extractors, rules, routes and the model."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, NGram, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
PROGRAMS = ("BIO", "CS", "DSA", "ECON", "EE", "IE", "MAN", "MAT", "ME", "PSIR", "PSY", "VACD")
REQUIREMENTS = {"required": ("required", "zorunlu", "must"), "core": ("core", "cekirdek"), "area": ("area", "alan"), "free": ("free", "serbest"), "university": ("university", "universite", "common")}
SEASON_SUFFIX = {"fall": "01", "guz": "01", "spring": "02", "bahar": "02", "summer": "03", "yaz": "03"}
DOCUMENT_TYPES = (
    (("schedule", "time", "meeting", "meet", "crn", "section", "instructor", "saat", "program", "sube"), ("schedule_section", "schedule_course_list")),
    (
        ("graduation", "mezuniyet", "bscs", "degree evaluation", "audit", "graduate", "total su credits", "minimum total", "kredi", "dağılım", "dagilim"),
        ("degree_requirement_profile", "degree_requirement_category_pool", "degree_requirement_pool_course", "graduation_requirement_summary", "graduation_requirement_category", "graduation_requirement_course", "graduation_requirement_course_list", "official_degree_evaluation_summary", "official_degree_evaluation_category", "official_degree_evaluation_course_assignment"),
    ),
    (("basic science", "temel bilim", "engineering ects", "muhendislik", "credit breakdown"), ("basic_science_credit", "course_catalog_overview")),
    (("description", "prerequisite", "prereq", "corequisite", "course catalog", "ders icerigi", "on kosul"), ("course_catalog_overview", "course_offering_history")),
    (("count", "sayilir", "sayılır", "elective", "secmeli", "required", "zorunlu", "curriculum", "requirement"), ("program_requirement", "program_requirement_list")),
    (("available terms", "which terms", "term list", "semester list", "donemler", "hangi donem"), ("available_term", "available_terms_summary")),
)
SOURCE_NEEDLES = ("embedding", "embeddings", "word2vec", "bert", "gpt", "transformer", "semantic search", "rag", "retrieval augmented", "dense retrieval", "reranking", "crossencoder", "cross-encoder", "prompt engineering", "kv cache", "fine-tuning", "finetuning")
GRADUATION_NEEDLES = ("graduation", "mezuniyet", "degree evaluation", "audit", "graduate", "total su credits", "kredi", "dağılım", "dagilim", "requirement")
ROUTES = (
    ("review", "review", r"hoca|hocanın|hocanin|prof|professor|instructor|öğretmen|ogretmen|zor mu|kolay mı|kolay mi|nasıl biri|nasil biri|yorum|review|yücel|yucel|saygın|saygin|ercan|solak|cem say"),
    ("exam", "exam", r"final|midterm|quiz|sınav|sinav|exam|soruları|sorulari|çıkmış|cikmis|ne çıkar|ne cikar|past paper"),
    ("mezuniyet_durumu", "course", r"mezuniyet\w*|mezun\w*|kredi\w*|credit\w*|degree evaluation|degree audit|audit|kalan ders|kalan kredi|requirements?|requirement|hangi derslerim sayıldı|hangi derslerim sayildi"),
    ("ders_onerisi", "course", r"ders öner|ders oner|hangi ders|program öner|program oner|schedule|next semester|gelecek dönem|gelecek donem|nlp|web|data|ai|security|systems"),
)
COURSE_INTENTS = ("mezuniyet_durumu", "ders_onerisi", "ders_ayrintisi", "calisma_plani", "major_secimi", "alanda_ozellesme")


def has_any(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def course_ids(query: Column) -> Column:
    pattern = F.lit(r"\b([A-Z]{2,5})\s*-?\s*(\d{3}[A-Z]?)\b")
    pairs = F.zip_with(F.regexp_extract_all(F.upper(query), pattern, F.lit(1)), F.regexp_extract_all(F.upper(query), pattern, F.lit(2)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def term_codes(query: Column) -> Column:
    codes = F.regexp_extract_all(query, F.lit(r"\b(20\d{2}0[123])\b"), F.lit(1))
    named = F.lit(r"(?iU)\b(fall|spring|summer|guz|bahar|yaz)\s+(20\d{2})\s*[-/]\s*(20\d{2})\b")
    suffix = F.create_map(*[F.lit(x) for pair in SEASON_SUFFIX.items() for x in pair])
    spelled = F.zip_with(F.regexp_extract_all(query, named, F.lit(1)), F.regexp_extract_all(query, named, F.lit(2)), lambda season, year: F.concat(year, F.try_element_at(suffix, F.lower(season))))
    return F.array_distinct(F.array_compact(F.concat(codes, spelled)))


def programs(query: Column) -> Column:
    longest = sorted(PROGRAMS, key=lambda p: (-len(p), p))
    return F.filter(F.array(*[F.when(F.upper(query).rlike(rf"\b{p}\b"), p) for p in longest]), lambda x: x.isNotNull())


def requirement_types(query: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has_any(F.lower(query), needles), kind) for kind, needles in REQUIREMENTS.items()]))


def document_types(query: Column) -> Column:
    found = F.array().cast("array<string>")
    for needles, kinds in reversed(DOCUMENT_TYPES):
        found = F.when(has_any(F.lower(query), needles), F.array(*[F.lit(k) for k in kinds])).otherwise(found)
    return found


def source_collection(query: Column) -> Column:
    return F.when(has_any(F.lower(query), SOURCE_NEEDLES), "sources").otherwise("")


def is_graduation(query: Column) -> Column:
    return has_any(F.lower(query), GRADUATION_NEEDLES)


def route(query: Column, intent: Column) -> Column:
    """struct<intent, document_types, use_multi_search>; the first rule that fits, else the given intent."""
    made = lambda name, kinds, many: F.struct(name.alias("intent"), F.array(*[F.lit(k) for k in kinds]).alias("document_types"), F.lit(many).alias("use_multi_search"))
    known = F.coalesce(F.nullif(intent, F.lit("")), F.lit("diger"))
    found = F.when(known.isin(*COURSE_INTENTS), made(known, ("course",), False)).otherwise(made(known, ("course", "exam", "review"), True))
    for name, kind, pattern in reversed(ROUTES):
        found = F.when(query.rlike(rf"(?iU)\b({pattern})\b"), made(F.lit(name), (kind,), False)).otherwise(found)
    return found


class IntentModel:
    """TF-IDF of word 1- and 2-grams, with smoothed idf and unit length, under a class-balanced multinomial logistic regression."""

    def __init__(self, counts: PipelineModel, idf: list[float], model, classes: list[str]):
        self.counts, self.idf, self.model, self.classes = counts, idf, model, classes

    @staticmethod
    def _grams() -> list:
        words = RegexTokenizer(inputCol="query", outputCol="words", pattern=r"(?U)\w\w+", gaps=False)
        return [words, NGram(n=2, inputCol="words", outputCol="pairs")]

    @classmethod
    def fit(cls, rows: DataFrame) -> "IntentModel":
        """``rows``: query, intent; a small built-in table."""
        spark = rows.sparkSession
        grams = Pipeline(stages=cls._grams()).fit(rows).transform(rows).withColumn("grams", F.concat("words", "pairs"))
        vocabulary = CountVectorizer(inputCol="grams", outputCol="tf").fit(grams)
        n = rows.count()
        df = {r.g: r.n for r in grams.select(F.explode(F.array_distinct("grams")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
        idf = [math.log((1 + n) / (1 + df[g])) + 1 for g in vocabulary.vocabulary]
        classes = sorted(r.intent for r in rows.select("intent").distinct().collect())
        self = cls(vocabulary, idf, None, classes)
        sizes = rows.groupBy("intent").agg((F.lit(float(n)) / (F.lit(len(classes)) * F.count(F.lit(1)))).alias("weight"))
        labels = spark.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], "intent string, label double")
        train = self._features(rows).join(F.broadcast(sizes), "intent").join(F.broadcast(labels), "intent")
        self.model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", standardization=False, regParam=1.0 / n, maxIter=200).fit(train)
        return self

    def _features(self, rows: DataFrame) -> DataFrame:
        grams = Pipeline(stages=self._grams()).fit(rows).transform(rows).withColumn("grams", F.concat("words", "pairs"))
        counted = self.counts.transform(grams)
        weighed = F.zip_with(vector_to_array("tf"), F.array(*[F.lit(x) for x in self.idf]), lambda a, b: a * b)
        norm = F.sqrt(F.aggregate("weighed", F.lit(0.0), lambda s, x: s + x * x))
        return counted.withColumn("weighed", weighed).withColumn("norm", norm).withColumn("features", array_to_vector(F.transform("weighed", lambda x: x / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)))).drop("words", "pairs", "grams", "tf", "weighed", "norm")

    # Stored models. A version is a folder of vocabulary, weights and facts; facts are written last and make it whole.

    @staticmethod
    def _versions(spark: SparkSession, path: str) -> list[int]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/facts/_SUCCESS"))
        return sorted(int(n) for n in names if n.isdigit() and whole(n))

    def save(self, spark: SparkSession, path: str) -> int:
        """The model as the next version below ``path``."""
        version = (self._versions(spark, path) or [0])[-1] + 1
        self.counts.write().overwrite().save(f"{path}/{version}/counts")
        self.model.write().overwrite().save(f"{path}/{version}/weights")
        spark.createDataFrame([(self.idf, self.classes)], "idf array<double>, classes array<string>").write.mode("overwrite").parquet(f"{path}/{version}/facts")
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> "IntentModel":
        """A stored version, the last if none is named. Nothing is fitted."""
        known = cls._versions(spark, path)
        if not known:
            raise FileNotFoundError(f"no model below {path}")
        at = f"{path}/{version or known[-1]}"
        facts = spark.read.parquet(f"{at}/facts").first()
        return cls(CountVectorizerModel.load(f"{at}/counts"), list(facts.idf), LogisticRegressionModel.load(f"{at}/weights"), list(facts.classes))

    def predict(self, rows: DataFrame, threshold: float = 0.3) -> DataFrame:
        """``rows`` with intent and confidence; below the threshold the intent is ``diger``."""
        done = self.model.transform(self._features(rows)).withColumn("p", vector_to_array("probability"))
        best = F.array_max("p")
        name = F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.array_position("p", best).cast("int"))
        return done.withColumn("confidence", best).withColumn("intent", F.when(best < threshold, "diger").otherwise(name)).select(*rows.columns, "intent", "confidence")


def training_rows(spark: SparkSession) -> DataFrame:
    from vellum.plans.intent_rows import ROWS

    return spark.createDataFrame([(q, intent) for intent, queries in ROWS.items() for q in queries], "query string, intent string")


_LOADED: dict[tuple[str, str], IntentModel] = {}


def intent_model(spark: SparkSession, path: str) -> IntentModel:
    """The model below ``path``, loaded once a session; the first caller of an empty folder fits it on the built-in rows and stores it."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _LOADED:
        if not IntentModel._versions(spark, path):
            IntentModel.fit(training_rows(spark)).save(spark, path)
        _LOADED[key] = IntentModel.load(spark, path)
    return _LOADED[key]


def detect(spark: SparkSession, path: str, questions: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``questions`` (query, ...) with intent and confidence, by the stored model."""
    return intent_model(spark, path).predict(questions, threshold)
