"""Queries over whole tables against plain Python, on planted rows that the queries with SQL leave out."""

import hashlib
import re

from vellum.functions import text as T
from vellum.plans import answers, intent
from vellum.plans.queries import QUERIES
from vellum.sources import documents as sources

PII = re.compile(T.PII.removeprefix("(?U)"))


def redact(text):
    return PII.sub("[redacted]", text).strip()


def parsed(turns):
    """(index, author, n_chars, date) of the messages of one conversation."""
    head = lambda t: "[1.2.2024 10:15] " if t % 2 == 0 else "1.2.2024, 10:15 AM - "
    text = "\n".join(f"{head(t)}{role or ''}: {said or ''}" for t, role, said in sorted(turns, key=lambda x: x[0]))
    found = []
    for line in filter(None, map(str.strip, re.split(r"\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]", text))):
        if m := re.match(sources.BRACKET, line, re.A) or re.match(sources.DASH, line, re.A):
            found.append([m[1], redact(m[3] or ""), [redact(m[4])]])
        elif found:
            found[-1][2].append(redact(line))
        else:
            found.append(["", "", [redact(line)]])
    said = [(author, len(x), date) for date, author, x in ((d, a, " ".join(y).strip()) for d, a, y in found) if x]
    return [(i, *x) for i, x in enumerate(said)]


def test_chat_parse_whole(spark, tmp_path):
    rows = [
        (1, 0, "user", "call +90 532 123 45 67 or a.b@c.org\n[3.4.2023 9:05] eve: not mine"), (1, 1, "assistant", "at 10:15\n5/6/23, 7:08 PM - bob: hi\nmore"), (1, 2, "user", None),
        (2, 0, "user", "plain"), (3, 1, "user", "[x] 1:2"), (3, 0, "assistant", "\u00e9t\u00e9 \u015fu: 12"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for where in (str(tmp_path), "/root/testdata/sf0.001"):
        turns = {}
        for r in spark.read.parquet(f"{where}/conversations.parquet").collect():
            turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
        got = sorted((r.conv_id, r["index"], r.author, r.n_chars, r.date) for r in QUERIES["chat_parse_whole"](spark, where).collect())
        assert got == sorted((c, *x) for c, t in turns.items() for x in parsed(t)) and {c for c, *_ in got} == set(turns)


def said(text, words, closed=False):
    return bool(re.search(rf"\b({words})" + (r"\b" if closed else ""), text, re.I))


def routed(text):
    return next((name for name, _, words in intent.ROUTES if said(text, words, True)), "diger")


def interest(text):
    plain = re.sub(r"\s+", " ", text.lower().strip())
    exact = [k for k, (_, names) in answers.INTERESTS.items() if plain in names]
    return next(iter(exact + [k for k, (_, names) in answers.INTERESTS.items() if re.search(r"\b(" + "|".join(map(re.escape, names)) + r")\b", plain)]), None)


def resolved(text):
    plain = re.sub(r"\s+", " ", text.lower().strip())
    coded = said(text, answers.COURSE_CODE, True) and not said(text, answers.EXPLICIT_RECOMMENDATION) and not said(text, answers.GRADUATION_ONLY, True)
    detail = said(text, answers.COURSE_DETAIL) or coded
    short = plain in [x for _, names in answers.INTERESTS.values() for x in names] or (len(plain) <= 120 and interest(text) is not None and not said(plain, answers.NOT_RECOMMENDATION, True))
    rules = [(said(text, answers.GRADUATION) and not detail, "mezuniyet_durumu"), (detail, "ders_ayrintisi"), (said(text, answers.STUDY_PLAN), "calisma_plani"), (said(text, answers.MAJOR), "major_secimi"), (said(text, answers.SPECIALIZATION), "alanda_ozellesme"), (said(text, answers.RECOMMENDATION) or short, "ders_onerisi")]
    return next((name for fits, name in rules if fits), "diger")


def test_whole_documents(spark, tmp_path):
    texts = ["gelecek dönem için program öner", "öğretmen nasıl biri", "sınav soruları çıkmış mı", "caf\u00e9 \u2013 mail j\u00fcrgen@b\u00fccher.de or +49 30 1234567", "veri bilimi \u2013 data", "mezuniyet için kalan ders", "CS 412 dersi nasıl?", "\u00e7al\u0131\u015fma plan\u0131", "plain ascii text", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for where in (str(tmp_path), "/root/testdata/sf0.001"):
        docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
        got = {r.doc_id: (r.digest, r.changed) for r in QUERIES["pii_redact_whole"](spark, where).collect()}
        assert got == {i: (hashlib.sha256(redact(x).encode()).hexdigest(), int(redact(x) != x)) for i, x in docs.items()}
        assert {r.doc_id: r.intent for r in QUERIES["route_rules_whole"](spark, where).collect()} == {i: routed(x) for i, x in docs.items()}
        assert {r.doc_id: (r.area, r.intent) for r in QUERIES["resolve_intent_whole"](spark, where).collect()} == {i: (interest(x), resolved(x)) for i, x in docs.items()}


def test_whole_ids(spark):
    where = "/root/testdata/sf0.001"
    users = {r.o_custkey for r in spark.read.parquet(f"{where}/orders.parquet").select("o_custkey").collect()}
    got = {r.user_id for r in QUERIES["user_profile_whole"](spark, where).select("user_id").distinct().collect()}
    assert len(got) > 3 and got <= users
    ids = {r.vec_id for r in spark.read.parquet(f"{where}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}
    assert {r.query_id for r in QUERIES["batch_dense_topk_whole"](spark, where).collect()} == ids
