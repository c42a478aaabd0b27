"""Phrases against a plain search; expressions against a recursive reader of their own."""

import random
import re

from pyspark.sql import functions as F

from vellum.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TAG = "SPDX-License-Identifier: "


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("labels", "score", "n_words", "expressions", "label")})
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


def test_phrases(spark):
    r = random.Random(2)
    pieces = ["CC BY", "cc-by-NC", "cc", "by", "All rights", "reserved", "ALL RIGHTS RESERVED.", "general public license", "GNU Lesser General Public License", "MIT license", "é", "cc0", "x", "\n", "CC\u00a0BY", "Kcc by"]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randrange(1, 12))) for _ in range(200)] + ["", None, " ", "word " * 100_000 + "cc by " * 3, "CC BYCC BY CC BY"]
    got = scanned(spark, texts)
    for i, text in enumerate(texts):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = {p: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p in licenses.NOTICES | licenses.BASE}
        base = sorted(k for p in licenses.BASE for k in at[p])
        labels = {label for p, label in (licenses.NOTICES | licenses.BASE).items() if at[p]}
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(words), len(base), min(base, default=None), max(base, default=None))
        assert x.base_labels == ",".join(sorted({licenses.BASE[p] for p in licenses.BASE if at[p]})) and x.labels == ",".join(sorted(labels))
        assert x.score == max((licenses.restriction(y) for y in labels), default=0.0)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def value(tokens):
    """Restriction of a well-formed expression, by recursive descent."""

    def either():
        left = both()
        while tokens and tokens[0] == "OR":
            tokens.pop(0)
            left = min(left, both())
        return left

    def both():
        left = one()
        while tokens and tokens[0] == "AND":
            tokens.pop(0)
            left = max(left, one())
        return left

    def one():
        token = tokens.pop(0)
        if token == "(":
            left = either()
            assert tokens.pop(0) == ")"
            return left
        left = licenses.restriction(token.lower())
        if tokens and tokens[0] == "WITH":
            del tokens[:2]
            left *= licenses.LOOSENED
        return left

    return either()


def test_expressions(spark):
    r = random.Random(7)
    ids = ["MIT", "GPL-2.0-only", "AGPL-3.0+", "Apache-2.0", "MPL-2.0", "BSD-3-Clause", "LicenseRef-own"]

    def made(depth):
        if depth == 0 or r.random() < 0.3:
            return [r.choice(ids)] + (["WITH", "LLVM-exception"] if r.random() < 0.2 else [])
        inner = [*made(depth - 1), r.choice(["OR", "AND"]), *made(depth - 1)]
        return ["(", *inner, ")"] if r.random() < 0.5 else inner

    tokens = [made(4) for _ in range(150)]
    got = scanned(spark, [TAG + " ".join(t) for t in tokens])
    for i, t in enumerate(tokens):
        assert got[i].labels == ",".join(sorted({x.lower() for x in t if x in ids})) and abs(got[i].score - value(list(t))) < 1e-12


def test_odd_tags(spark):
    long = " OR ".join(["MIT"] * 60) + " AND AGPL-3.0-only"
    cases = {
        TAG + long: ("agpl-3.0-only,mit", 0.1), TAG + " AND ".join(["MIT"] * 300 + ["AGPL-3.0"]): ("agpl-3.0,mit", 0.7), TAG + "banana OR is good": ("", 0.0), TAG + "MIT OR banana": ("mit", 0.1),
        TAG + "GPL-2.0 WITH Classpath-exception-2.0": ("gpl-2.0", 0.6 * licenses.LOOSENED), TAG + "GPL-2.0 WITH banana": ("gpl-2.0", 0.6), f"{TAG}MIT some words {TAG}GPL-3.0": ("gpl-3.0,mit", 0.6),
        f"{TAG}{TAG}ISC\n{TAG}\nMIT": ("isc", 0.1), f"{TAG}MIT OR {TAG}GPL-2.0": ("gpl-2.0,mit", 0.6), TAG + "(MIT": ("mit", 0.1), TAG + "MIT AND": ("mit", 0.1), TAG + "AND MIT": ("", 0.0), TAG + "(MIT OR (": ("mit", 0.1),
        "License: Apache-2.0. MIT too": ("apache-2.0", 0.15), "sublicense: MIT": ("", 0.0), "the licence: see below": ("", 0.0), "license:MIT\r\nlicence: GPL-3.0": ("gpl-3.0,mit", 0.6), TAG + "LicenseRef-x": ("licenseref-x", 0.5),
    }
    got = scanned(spark, list(cases))
    assert {t: (got[i].labels, round(got[i].score, 9)) for i, t in enumerate(cases)} == {t: (a, round(b, 9)) for t, (a, b) in cases.items()}


def test_identifiers_of_the_list_and_what_stays_unread(spark):
    cases = {
        TAG + "MIT AND EUPL-1.2": ("eupl-1.2,mit", 0.5), TAG + "MIT AND CDDL-1.0": ("cddl-1.0,mit", 0.5), TAG + "EUPL-1.2": ("eupl-1.2", 0.5), TAG + "BSL-1.0 OR MIT": ("bsl-1.0,mit", 0.1),
        TAG + "Artistic-2.0 AND GPL-3.0": ("artistic-2.0,gpl-3.0", 0.6), "License: GPLv3": ("gplv3", 0.6), '{"license": "GPL-3.0", "name": "x"}': ("gpl-3.0", 0.6), TAG + "MIT/GPL-2.0": ("gpl-2.0,mit", 0.1),
        TAG + "MIT AND something else": ("mit", 0.5), TAG + "MIT OR something else": ("mit", 0.1), TAG + "MIT OR ISC AND (what": ("isc,mit", 0.1), TAG + "GPL-2.0 WITH Linux-syscall-note": ("gpl-2.0", 0.6 * 0.75),
        "License: see section-3 of the Terms": ("", 0.0), "license: curl": ("curl", 0.5), "licence': 'X11'": ("x11", 0.5), TAG + "Foo-Bar-2.1-only": ("foo-bar-2.1-only", 0.5),
    }
    got = scanned(spark, list(cases))
    for i, (text, (labels, score)) in enumerate(cases.items()):
        assert (got[i].labels, round(got[i].score, 9)) == (labels, round(score, 9)), text
    assert [got[i].expressions for i in (0, 8)] == ["mit eupl-1.2 and", "mit ? and"]
