"""Linking of weak parts against a plain comparison of all pairs, on texts full of them, and redaction."""

import random
import re

from pyspark.sql import functions as F

from vellum.llm import secrets

SCHEMA = "doc_id long, text string, n_chars long"


def parts_of(text):
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(secrets.KINDS.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return sorted(found)


def linked(text):
    """Spans, and weak spans with their nearest partners, by comparing each part with every other."""
    parts, spans, links = parts_of(text), [], []
    for i, (start, rank, end, kind) in enumerate(parts):
        said = {}
        for name, kinds in secrets.CLASSES.items():
            left = [(e, s, k) for s, _, e, k in parts[:i] if k in kinds]
            right = [(s, e, k) for s, _, e, k in parts[i + 1 :] if k in kinds]
            near = []
            if left and max(left)[0] >= start - secrets.SCOPE:
                e, s, k = max(left)
                near.append(f"{k}:{s}:{e}")
            if right and min(right)[0] <= end + secrets.SCOPE:
                s, e, k = min(right)
                near.append(f"{k}:{s}:{e}")
            reach = any(s <= end + secrets.SCOPE and e >= start - secrets.SCOPE for j, (s, _, e, k) in enumerate(parts) if j != i and k in kinds)
            assert bool(near) == reach  # the nearest on either side stand for all pairs
            said[name] = near
        fits = {"key": said["identifier"] or said["place"], "identifier": said["secret"], "endpoint": said["secret"] and said["identifier"]}.get(kind, True)
        if fits:
            spans.append(f"{kind}:{start}:{end}")
            if kind in secrets.WEAK:
                partners = {"key": said["identifier"] + said["place"], "identifier": said["secret"], "endpoint": said["secret"] + said["identifier"]}[kind]
                links.append(f"{kind}:{start}:{end}>{'+'.join(partners)}")
    return ",".join(spans), ",".join(links)


def made(n):
    r = random.Random(8)
    pieces = [
        "user: joe", 'login = "anna.b"', "pwd=hunter2x", "key: abcdef123", "https://x.y/z", "host=db.local:5432", "password=longenough1", "AKIA" + "B2" * 9, "0123456789abcdef" * 3,
        "secret: 'a'", "client_id=4711", "postgres://u@h/db", "pass = 1", "https://long.example/" + "p" * 260, "é" * 30, "w " * 40, "w " * 101, "\n", "ü word ",
    ]
    return [" ".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(n)]


def test_links(spark):
    texts = [*made(250), "", None, "user: joe pwd=hunter2x", "user: joe", "pwd=hunter2x", "https://a.b/" + "c" * 300 + " pwd=hunter2x", "https://a.b/" + "c" * 300 + " w" * 110 + " pwd=hunter2x", " ".join(made(400)), "x " * 200_000 + "user: joe pwd=hunter2x"]
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts)] + [(0, texts[0], 1)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs.withColumns({c: F.lit(i) for i, c in enumerate(("row", "doc", "parts", "kind", "rank", "start", "end", "spans", "links", "island", "sec_row", "sec_text"))})
    for table in (docs, clash):
        got = [(r.doc_id, r.spans, r.links) for r in secrets.scan(table).collect()]
        assert sorted(got) == sorted((i, *linked(t or "")) for i, t, _ in rows)
    said = [linked(t or "")[1] for t in texts]
    assert sum(map(bool, said)) > 100 and said[255].startswith("endpoint") is False and said[255].count(">endpoint:0:") == 1 and said[256] == ""


def masked(text):
    """A text with its reported spans masked."""
    out, at = "", 0
    spans = sorted(tuple(map(int, x.split(":")[1:])) for x in filter(None, linked(text or "")[0].split(",")))
    while spans:
        start, end = spans.pop(0)
        while spans and spans[0][0] < end:
            end = max(end, spans.pop(0)[1])
        out, at = out + text[at:start] + secrets.MASK, end
    return None if text is None else out + text[at:]


def test_redaction(spark):
    texts = [*made(120), "", None, "plain", "pwd=hunter2x alone"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(0, texts[0], 7)], SCHEMA).withColumns({c: F.lit(c) for c in ("row", "doc", "parts", "spans", "sec_id", "sec_text", "end")})
    done = secrets.redacted(docs)
    assert done.columns == docs.columns
    rows = done.collect()
    assert len(rows) == len(texts) + 1 and all((r.row, r.doc, r.end, r.sec_id) == ("row", "doc", "end", "sec_id") for r in rows)
    for r in rows:
        text, want = texts[r.doc_id], masked(texts[r.doc_id])
        assert r.text == want and r.n_chars == (7 if want == text else len(want))
    assert secrets.redacted(docs.limit(0)).count() == 0
