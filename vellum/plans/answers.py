"""From question to prompt: intent rules, interests, query expansion, context cards, candidates and the profile."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.text import maybe, say
from vellum.plans.catalog import items

# Fixed values.
TERM = "202502"
CREDITS = 125
GRADUATION = "mezuniyet|mezun|kredi|credit|credits|degree evaluation|degree audit|audit|kalan ders|kalan kredi|requirements?|requirement|kategori|dağılım|dagilim|hangi derslerim sayıldı|hangi derslerim sayildi"
EXPLICIT_RECOMMENDATION = "hangi dersleri alayım|hangi dersleri alayim|hangi dersi alayım|hangi dersi alayim|ders öner|ders oner|öner|oner|recommend|recommendation|gelecek dönem|gelecek donem|next semester|ders programı|ders programi|program öner|program oner|program oluştur|program olustur|schedule"
RECOMMENDATION = EXPLICIT_RECOMMENDATION + "|kolay|rahat|zor|ağır|agir|yoğun|yogun"
STUDY_PLAN = "nasıl çalış|nasil calis|çalışma planı|calisma plani|çalışma plan|calisma plan|sınavlarına nasıl|sinavlarina nasil|hazırlanılır|hazirlanilir|A ile geç|a ile gec|geçmek için|gecmek icin|study plan"
MAJOR = "hangi bölüm|hangi bolum|bölümü seç|bolumu sec|major seç|major sec|ana dal|anadal|cs mi|bilgisayar bilimleri seçmek|endüstri mi|endustri mi"
SPECIALIZATION = "özelleş|ozelles|uzmanlaş|uzmanlas|alt dal|yönel|yonel|nlp mi|security mi|data alanında|data alaninda|yapay zeka alanında|yapay zeka alaninda"
COURSE_DETAIL = "kim veriyor|hoca|hocanın|hocanin|syllabus|içeriği|icerigi|dersin içeriği|dersin icerigi|notlandırması|notlandirmasi|prerequisite|önkoşul|onkosul|workload|zor mu"
GRADUATION_ONLY = "mezuniyet|mezun|kalan|eksik|degree audit|degree evaluation|kategori|dağılım|dagilim"
NOT_RECOMMENDATION = "nedir|ne demek|açıkla|acikla|kim veriyor|hoca|nasıl çalış|nasil calis|çalışmalıyım|calismaliyim|syllabus|içeriği|icerigi"
COURSE_CODE = r"[A-Z]{2,5}\s*\d{3,5}"
INTERESTS = {
    "ai": ("AI", ("ai", "artificial intelligence", "yapay zeka", "yapay zekâ", "machine learning", "ml", "deep learning", "dl")),
    "data": ("Data Science", ("data", "data science", "veri bilimi", "veri analitiği", "veri analitigi")),
    "nlp": ("NLP", ("nlp", "natural language", "doğal dil", "dogal dil", "chatbot", "duygu analizi", "sentiment", "language model", "dil model", "llm", "llms", "metin işleme", "metin isleme")),
    "security": ("Security", ("security", "cybersecurity", "siber güvenlik", "siber guvenlik", "güvenlik", "guvenlik")),
    "systems": ("Systems", ("systems", "sistem", "distributed", "cloud", "operating systems", "os")),
    "web": ("Web", ("web", "frontend", "backend", "full stack", "full-stack", "uygulama geliştirme", "uygulama gelistirme")),
}
HINTS = {
    "nlp": ("CS445", "CS455", "CS412", "CS415", "DSA440", "EE417", "ECON494", "CS460", "CS48004"),
    "ai": ("CS404", "CS412", "CS415", "CS455", "DSA440", "EE417", "CS48011", "ECON495"),
    "data": ("CS412", "CS445", "DSA301", "DSA428", "DSA440", "DSA473", "ECON494", "ECON495", "OPIM390"),
    "security": ("CS432", "CS437", "CS438", "CS48008", "CS411", "CS408"),
    "systems": ("CS307", "CS401", "CS403", "CS406", "CS408", "CS436", "CS460"),
    "web": ("CS306", "CS308", "CS310", "CS442", "CS449", "CS48004", "VA325"),
}
SUFFIXES = {
    "review": "instructor professor review workload grading difficulty course experience",
    "exam": "exam final midterm quiz past questions solutions assessment",
    "mezuniyet_durumu": "official degree evaluation BSCS graduation requirements university courses required courses core electives area electives free electives",
    "calisma_plani": "course syllabus assignments exams study plan workload",
    "ders_ayrintisi": "course detail instructor syllabus schedule prerequisite workload",
    "major_secimi": "Sabanci program requirements course catalog specialization career",
    "alanda_ozellesme": "Sabanci program requirements course catalog specialization career",
}
INTENT_TEXTS = {
    "ders_onerisi": "Detected intent: ders_onerisi / course recommendation / schedule planning. Do not produce graduation audit. Do not summarize completed credits. Never start with any sentence about checking graduation status. Already taken course codes, strictly forbidden to recommend: {}. Use MongoDB profile only as a taken-course exclusion list and for personalization.",
    "mezuniyet_durumu": "Detected intent: mezuniyet_durumu / graduation audit. Use official degree evaluation and degree requirement RAG sources with MongoDB student profile.",
    "calisma_plani": "Detected intent: calisma_plani / study plan. Give course-specific study guidance. Do not produce graduation audit unless explicitly requested.",
    "ders_ayrintisi": "Detected intent: ders_ayrintisi / course detail. Answer the requested course detail such as instructor, schedule, syllabus, prerequisite or workload. Do not produce graduation audit.",
    "review": "Detected intent: review / instructor or course review. Use only instructor review chunks and clearly separate retrieved student sentiment from official course facts.",
    "exam": "Detected intent: exam / past exam or assessment question. Use exam chunks and course context; do not invent unavailable questions or answers.",
    "major_secimi": "Detected intent: major_secimi / major selection. Compare programs and fit using catalog context. Do not produce graduation audit.",
    "alanda_ozellesme": "Detected intent: alanda_ozellesme / specialization guidance. Use catalog and course context to guide subfield choice. Do not produce graduation audit.",
}
ASK_TO_RECOMMEND = "COURSE_RECOMMENDATION_MODE. The user is asking for course recommendations, not graduation audit. Do not mention graduation status, 125/125 credits, or category audit unless the user explicitly asks for it in this same message. Never start with any sentence about checking graduation status. The user already provided the interest area: {}. Do not ask another clarifying question about the area; produce the course program now. Already taken course codes, do not recommend any of these: {}. If the obvious courses in the requested area are already taken, say that clearly and recommend adjacent untaken courses only. Unless the user asks for a different count, recommend exactly 5 untaken courses. For each course, include: course code, title, instructor if available in context, why it fits the interest area, and the schedule if available. Original user question: {}"
STRATEGY = "[Source: Course recommendation strategy]\nInterest area: {}.\nPrimary/adjacent course hints for this area: {}.\nAlready taken course codes, never recommend again: {}.\nIf primary courses are already taken, explicitly say so and recommend adjacent/supportive untaken courses. Do not ask the user to choose a narrower subarea; produce the program now."
PROFILE = "User profile from MongoDB: {}.\nAuthoritative completed SU credit total from MongoDB: {}/125 SU credits.\nAuthoritative remaining SU credits to 125: {}.\nAuthoritative completed course count from MongoDB: {}.\nUse the authoritative MongoDB total for final graduation arithmetic. Do not recompute the final x/125 total from memory if this line is present.\nImportant intent guard: this profile contains graduation totals, but use them only when the user explicitly asks for graduation, credit, audit, or degree evaluation. For course recommendation questions, use this profile only as a taken-course exclusion list.\nTaken/completed courses selected by the user:\n{}\nUse this personal course history when answering eligibility, prerequisite, recommendation, or personalization questions."
NO_PROFILE = "User profile: {}. No completed/taken courses are currently stored in MongoDB."
COMPACT_PROFILE = "User profile from MongoDB: {}.\nIntent: course recommendation only, not graduation audit.\nTaken/completed courses that must not be recommended again:\n{}"
NO_COMPACT_PROFILE = "User profile from MongoDB: {}.\nNo taken/completed courses are stored. Use general recommendation rules."
SCRUBBED = (r"Öncelikle mezuniyet durumunu", r"Mezuniyet durumunu")


def _said(question: Column, words: str, closed: bool = False) -> Column:
    """Whether one of the words starts in the question, and with ``closed`` ends there too."""
    return F.coalesce(question, F.lit("")).rlike(rf"(?iU)\b({words})" + (r"\b" if closed else ""))


def _plain(question: Column) -> Column:
    return F.regexp_replace(T.strip(F.lower(F.coalesce(question, F.lit("")))), r"(?U)\s+", " ")


def _any_alias() -> list[str]:
    return [alias for _, names in INTERESTS.values() for alias in names]


def interest(question: Column) -> Column:
    """Key of the interest area: a question that is an alias, else the first area with an alias among its words; else null."""
    plain, found = _plain(question), F.lit(None).cast("string")
    for key, (_, names) in reversed(INTERESTS.items()):
        found = F.when(plain.rlike(r"(?U)\b(" + "|".join(map(re.escape, names)) + r")\b"), key).otherwise(found)
    for key, (_, names) in reversed(INTERESTS.items()):
        found = F.when(plain.isin(*names), key).otherwise(found)
    return found


def interest_label(question: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for key, (label, _) in INTERESTS.items() for x in (key, label)]), interest(question))


def is_short_interest(question: Column) -> Column:
    """A bare alias, or a short question about an area that doesn't ask for an explanation."""
    plain = _plain(question)
    phrase = (F.length(plain) <= 120) & interest(question).isNotNull() & ~_said(plain, NOT_RECOMMENDATION, closed=True)
    return plain.isin(*_any_alias()) | phrase


def is_course_detail(question: Column) -> Column:
    coded = _said(question, COURSE_CODE, closed=True) & ~_said(question, EXPLICIT_RECOMMENDATION) & ~_said(question, GRADUATION_ONLY, closed=True)
    return _said(question, COURSE_DETAIL) | coded


def resolve(question: Column, detected: Column) -> Column:
    """The intent by rules, else the detected one."""
    return (
        F.when(_said(question, GRADUATION) & ~is_course_detail(question), "mezuniyet_durumu").when(is_course_detail(question), "ders_ayrintisi").when(_said(question, STUDY_PLAN), "calisma_plani")
        .when(_said(question, MAJOR), "major_secimi").when(_said(question, SPECIALIZATION), "alanda_ozellesme").when(_said(question, RECOMMENDATION) | is_short_interest(question), "ders_onerisi")
        .otherwise(T.or_else(detected, F.lit("diger")))
    )


def expanded_recommendation(question: Column) -> Column:
    label = interest_label(question)
    short = say("{} alanında gelecek dönem için 5 derslik ders programı öner. Öğrencinin aldığı dersleri tekrar önerme. Kullanıcının ilgi ayrıntısı: {}", label, question)
    long = say("{}\n\nÇıkarılan ilgi alanı: {}. Bu alan için 5 derslik program öner; alınmış dersleri tekrar önerme.", question, label)
    return F.when(label.isNull(), question).when(is_short_interest(question), short).otherwise(long)


def retrieval_query(question: Column, intent: Column) -> Column:
    """The question with its intent's search words; a recommendation's also with hinted courses and the term."""
    hints = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for key, codes in HINTS.items() for x in (key, " ".join(codes))]), interest(question)), F.lit(""))
    found = F.when(intent == "ders_onerisi", say(f"{{}} {{}} course recommendation Sabanci CS BSCS course catalog core electives area electives free electives schedule instructors {TERM} AI NLP Data Web Systems Security", expanded_recommendation(question), hints))
    for name, suffix in SUFFIXES.items():
        found = found.when(intent == name, say(f"{{}} {suffix}", question))
    return found.otherwise(question)


def _codes(taken: Column) -> Column:
    return F.coalesce(T.or_else(F.array_join(taken, ", "), F.lit("none")), F.lit("none"))


def intent_context(intent: Column, taken: Column) -> Column:
    """The context card that tells the intent; ``taken`` (array of codes) shows for recommendations."""
    found = F.when(F.lit(False), "")
    for name, text in INTENT_TEXTS.items():
        found = found.when(intent == name, say(text, _codes(taken)) if "{}" in text else F.lit(text))
    return F.concat(F.lit("[Source: Request intent]\n"), found.otherwise(say("Detected intent: {}. Answer only this academic intent using the retrieved context.", intent)))


def recommendation_question(question: Column, taken: Column) -> Column:
    return say(ASK_TO_RECOMMEND, F.coalesce(interest_label(question), F.lit("the requested area")), _codes(taken), question)


def strategy(question: Column, taken: Column) -> Column:
    """The strategy card of an area; null without one. Taken codes are shown in the order given."""
    hints = F.try_element_at(F.create_map(*[F.lit(x) for key, codes in HINTS.items() for x in (key, ", ".join(re.sub(r"^([A-Z]+)(\d.+)$", r"\1 \2", c) for c in codes))]), interest(question))
    shown = F.array_distinct(F.transform(F.coalesce(taken, F.array().cast("array<string>")), T.display_code))
    return F.when(interest(question).isNotNull(), say(STRATEGY, interest_label(question), hints, _codes(shown)))


def meeting_summary(sections: Column) -> Column:
    """The first two sections (struct<section, crn, meetings array<struct<instructors, days, time>>>) as a line."""

    def one(s: Column) -> Column:
        names = F.array_distinct(F.filter(F.transform(s["meetings"], lambda m: T.strip(F.replace(F.coalesce(m["instructors"], F.lit("")), F.lit("( P )"), F.lit("")))), lambda x: x != ""))
        times = F.filter(F.transform(s["meetings"], lambda m: T.lines(m["days"], m["time"], separator=" ")), lambda x: x != "")
        some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c)).otherwise("")
        return F.array_join(F.filter(F.array(some("section ", s["section"]), some("CRN ", s["crn"]), some("instructor(s): ", F.array_join(names, ", ")), some("meetings: ", F.array_join(times, ", "))), lambda x: x != ""), "; ")

    return F.coalesce(F.array_join(F.filter(F.transform(F.slice(sections, 1, 2), one), lambda x: x != ""), " | "), F.lit(""))


_SECTION = "struct<section:string,crn:string,meetings:array<struct<instructors:string,days:string,time:string>>>"


def term_rows(lines: DataFrame, term: str = TERM) -> tuple[DataFrame, DataFrame]:
    """Lookups of a term from the catalog's lines: program rows (code; the last row of a code stays) and sections (code, in the file's order)."""
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string").alias(name)
    program = lines.where(F.col("source_path") == f"{term}/CS.jsonl").select(T.clean_code(say("{}{}", text("Major"), text("Code"))).alias("code"), "line_no", *[text(n) for n in ("Course_Name", "EL_Type", "SU_credit", "ECTS", "Faculty")])
    fields = ["Course_Name", "EL_Type", "SU_credit", "ECTS", "Faculty"]
    program = program.where("code <> ''").groupBy("code").agg(F.max_by(F.struct(*fields), "line_no").alias("row")).select("code", "row")
    meetings = F.transform(items("v", "meetings"), lambda m: F.struct(*[F.try_variant_get(m, f"$.{n}", "string").alias(n) for n in ("instructors", "days", "time")]))
    said = lines.where(F.col("source_path") == f"schedule/{term}.jsonl").select(T.clean_code(F.try_variant_get("v", "$.course_id", "string")).alias("code"), "line_no", text("title"), F.struct(text("section"), text("crn"), meetings.alias("meetings")).cast(_SECTION).alias("section"))
    sections = said.where("code <> ''").groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "section"))), lambda x: x["section"]).alias("sections"), F.min_by("title", "line_no").alias("title"))
    return program, sections


def candidates(spark: SparkSession, key: str, taken: list[str], program: DataFrame, sections: DataFrame, term: str = TERM) -> DataFrame:
    """position, code, status and text of an area's hinted courses that the term has, in the hints' order."""
    done = [re.sub(r"\s+", "", c).upper() for c in taken]
    hints = spark.createDataFrame([(i, c, c in done) for i, c in enumerate(HINTS[key])], "position int, code string, taken boolean")
    near = F.broadcast(hints.select("code"))  # a dozen literal rows
    found = hints.join(program.join(near, "code", "left_semi"), "code", "left").join(sections.join(near, "code", "left_semi"), "code", "left").where("row is not null or sections is not null")
    shown, status = T.display_code(F.col("code")), F.when(F.col("taken"), "already_taken_do_not_recommend").otherwise("eligible_candidate")
    title = F.when(F.col("row").isNotNull(), F.col("row.Course_Name")).otherwise(F.col("title"))
    field = lambda label, c: say(f"{label}: {{}}\n", F.coalesce(F.col(f"row.{c}"), F.lit("None")))
    bits = maybe(F.concat(F.lit(f"major/list source: CS {term}\n"), field("category", "EL_Type"), field("SU credits", "SU_credit"), field("ECTS", "ECTS"), field("faculty", "Faculty")), F.col("row").isNotNull())
    summary = T.or_else(meeting_summary(F.col("sections")), F.lit("not found in loaded schedule context"))
    text = say(f"[Source: CS recommendation candidate {{}}]\nCourse: {{}} - {{}}\nRecommendation status: {{}}\n{{}}Schedule {term}: {{}}\n", shown, shown, title, status, bits, summary)
    return found.select("position", shown.alias("code"), status.alias("status"), text.alias("text"))


def profiles(users: DataFrame, taken: DataFrame) -> DataFrame:
    """username, profile, compact (for recommendations), total, remaining and n of users; ``taken``: username, code, title, subject, number, su_credits, ects, engineering_ects, basic_science_ects."""
    some = lambda label, c: F.when(F.col(c).isNotNull(), say(f"{label} {{}}", c)).otherwise("")
    full = F.array_join(F.filter(F.array(say("{} - {}", "code", "title"), some("SU credits", "su_credits"), some("ECTS", "ects"), some("engineering ECTS", "engineering_ects"), some("basic science ECTS", "basic_science_ects")), lambda x: x != ""), "; ")
    brief = F.concat(T.lines(F.col("code"), F.col("title"), separator=" - "), F.when(F.col("su_credits").isNotNull(), say(" (SU {})", "su_credits")).otherwise(""))
    rows = taken.select("username", F.struct("subject", "number", "code", say("- {}", full).alias("full"), F.when(brief != "", say("- {}", brief)).alias("brief")).alias("line"), T.su_credit(F.col("su_credits")).alias("credit"))
    summed = rows.groupBy("username").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.sum("credit").alias("total"), F.count(F.lit(1)).alias("n"))
    known = users.select("username").join(summed, "username", "left").withColumn("total", F.coalesce("total", F.lit(0.0))).withColumn("remaining", F.greatest(F.lit(float(CREDITS)) - F.col("total"), F.lit(0.0)))
    listed = lambda c: F.array_join(F.array_compact(F.transform("lines", lambda x: x[c])), "\n")
    profile = F.when(F.col("n").isNull(), say(NO_PROFILE, "username")).otherwise(say(PROFILE, "username", T.format_credit(F.col("total")), T.format_credit(F.col("remaining")), "n", listed("full")))
    compact = F.when(F.col("n").isNull(), say(NO_COMPACT_PROFILE, "username")).otherwise(say(COMPACT_PROFILE, "username", listed("brief")))
    return known.select("username", profile.alias("profile"), compact.alias("compact"), "total", "remaining", F.coalesce("n", F.lit(0)).alias("n"))


def scrub(response: Column) -> Column:
    """An answer without an opening sentence about graduation status."""
    for opening in SCRUBBED:
        response = F.regexp_replace(response, rf"(?iU)^\s*{opening}[^.\n]*(?:\.|\n)\s*", "")
    return T.strip(response)


def assemble(*groups: DataFrame) -> DataFrame:
    """Context cards (source, text) of groups in order, each by its ``position``: intent, strategy, candidates, profile, then ranked chunks."""
    numbered = [g.select(F.lit(i).alias("group"), "position", "source", "text") for i, g in enumerate(groups)]
    every = functools.reduce(DataFrame.unionByName, numbered)
    return every.withColumn("position", F.row_number().over(Window.orderBy("group", "position")) - 1).drop("group")


def prompt(question: Column, intent: Column, context: Column) -> Column:
    """What a language model would be asked; answering is left to the caller."""
    return say("Intent: {}\n\nContext:\n{}\n\nQuestion: {}", intent, context, question)


def cited(context: DataFrame, column: str = "source") -> list[str]:
    """Distinct labels of an assembled context, in its order; a context is at most a few dozen cards."""
    firsts = context.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.min("position").alias("at"))
    return [r[column] for r in firsts.orderBy("at").collect()]


def cited_many(contexts: DataFrame, keys: list[str], column: str = "source") -> DataFrame:
    """keys and labels: the distinct labels of each of many contexts (keys, position), in its order; contexts without a label have none."""
    firsts = contexts.groupBy(*keys, column).agg(F.min("position").alias("at"))
    named = F.struct("at", F.col(column).alias("label"))
    told = F.array_sort(F.collect_list(F.when(F.coalesce(F.col(column), F.lit("")) != "", named)))
    return firsts.groupBy(*keys).agg(F.transform(told, lambda x: x["label"]).alias("labels"))
