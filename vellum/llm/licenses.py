"""License scans: notice phrases and identifier tags in whole texts.

An Aho-Corasick automaton over all phrases passes once over each text,
reduced to its words (runs of letters, digits and characters beyond ASCII, A-Z
lower-cased) with single spaces between them, so that a phrase is found wherever
its words stand consecutively. Where a word of a tag is among them, a second automaton finds the tags in the text itself, with
their places. A tag is followed by a licence expression, up to the end of its line or the next tag; a shunting-yard parser turns that into postfix, and evaluation gives
its restriction: ``or`` (or a slash) leaves the choice and takes the least, ``and`` the greatest, ``with``
loosens what stands before it. Operands are identifiers: those that begin with a label of ``RESTRICTION`` or a name of ``FAMILIES``, those of SPDX's form (a capital first, a version
behind a hyphen), and references to a licence of one's own. One without a rank counts as ``UNKNOWN``. Reading stops at any other word, so prose behind a tag is no licence; what it leaves unread behind ``and`` is an operand
``?`` of ``UNKNOWN``, so nothing is called freer for what wasn't read. What follows ``with`` is an exception, not a licence, and no label.
A document's score is its greatest
restriction, from 0 (none found) to 1 (all rights reserved).

Null and empty texts have no words, no labels and score 0. Each row is scanned by
itself, so repeated rows repeat their result; an empty table gives no rows; extra columns are ignored, whatever their names. A very long text is scanned whole, in
a few bytes a byte; expressions of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import worker_cache

#: Phrases that always count, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: More notice phrases, in the words of the licences themselves.
NOTICES = {
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "public domain": "public-domain",
    "mit license": "mit", "apache license": "apache", "bsd license": "bsd", "isc license": "isc", "unlicense": "unlicense",
    "mozilla public license": "mpl", "eclipse public license": "epl", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd", "proprietary and confidential": "reserved",
}
#: Restriction of a label; an identifier counts as the longest of these that it starts with.
RESTRICTION = {
    "cc0": 0.05, "public-domain": 0.05, "unlicense": 0.05, "0bsd": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "apache": 0.15, "zlib": 0.1,
    "cc-by": 0.2, "cc-by-sa": 0.45, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "gpl": 0.6, "agpl": 0.7,
    "cc-by-nd": 0.8, "cc-by-nc": 0.8, "cc-by-nc-sa": 0.8, "cc-by-nc-nd": 0.85, "reserved": 1.0,
}
# Names of licences without a rank here, and exceptions whose names don't say so, as SPDX lists them.
FAMILIES = frozenset(
    "aal afl aladdin antlr-pd apsl artistic beerware blessing bsl busl bzip2 cc-pddc cddl cecill clartistic condor cpal cpl cpol crystalstacker curl d-fsl dsdp ecl efl egenix elastic entessa erlpl eudatagrid eupl "
    "fair frameworx freetype ftl gfdl giftware gl2ps glide glulxe gnuplot hpnd icu ijg imagemagick imatix info-zip intel ipa ipl jasper json lal latex2e leptonica libpng libtiff liliq linux-openib lppl "
    "mirros motosoto mpich2 ms-pl ms-rl mulanpsl multics naist nasa ncsa netcdf ngpl nlpl nokia nosl noweb nposl nrl ntp oclc ocsl odbl ofl ogc ogtsl oldap openssl osl php plexus postgresql psf python qhull "
    "qpl rpl rpsl rscpl ruby saxpath sgi-b simpl sissl sleepycat smlnj snia spencer sspl sugarcrm tcl tcp-wrappers tmate torque tosl ucl unicode upl vim vostrom vsl w3c watcom wtfpl wxwindows x11 xerox xfree86 xinetd xnet xpp ypl zend zimbra zpl".split()
)
EXCEPTIONS = frozenset(("gpl-cc-1.0", "linux-syscall-note", "llgpl", "shl-2.0", "shl-2.1"))
UNKNOWN, LOOSENED = 0.5, 0.75
#: What an expression stands behind, and the words that say that a text may hold one.
TAGS = tuple(f"{name}{quote}:" for name in ("spdx-license-identifier", "license", "licence") for quote in ("", '"', "'"))
HINTS = ("spdx license identifier", "license", "licence")
LINE = re.compile(r"[\r\n]")
TOKEN = re.compile(r"[()/]|[A-Za-z0-9.+:-]+")
VERSIONED = re.compile(r"[A-Z][A-Za-z0-9]*(-[A-Za-z][A-Za-z0-9]*)*-v?\d+(\.\d+)*\+?(-[A-Za-z0-9.]+)*\+?")
BINDS = {"or": 1, "and": 2, "with": 3}
#: References to licences of one's own, as SPDX writes them.
REFERENCE = ("licenseref-", "documentref-")
COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"


def known(label: str) -> str | None:
    """The longest label of ``RESTRICTION`` that an identifier begins with, also one like ``gplv3``."""
    label = re.sub(r"^(a?l?gpl)v?(?=\d)", r"\1-", label)
    return max((x for x in RESTRICTION if label == x or label.startswith((f"{x}-", f"{x}+"))), key=len, default=None)


def restriction(label: str) -> float:
    return RESTRICTION.get(known(label), UNKNOWN)


def identifier(token: str) -> bool:
    """Is it a licence's name, as it is written?"""
    word = token.lower()
    return bool(known(word) or word.startswith(REFERENCE) or VERSIONED.fullmatch(token)) or any(word[:i] in FAMILIES for i in [k for k, c in enumerate(word) if c in "-+"] + [len(word)])


def postfix(expression: str, begin: int = 0, end: int | None = None) -> list[str]:
    """Shunting-yard over ``expression[begin:end]``; reading stops where the text is no longer an expression. Empty if there is none."""
    out: list[str] = []
    held: list[str] = []
    operand, unread = True, False  # is an operand due; is there a word that can't be read
    for match in TOKEN.finditer(expression, begin, len(expression) if end is None else end):
        token = match[0]
        name = token.rstrip(".:-")
        word = "or" if token == "/" else name.lower()
        if operand and token == "(" and (not held or held[-1] != "with"):
            held.append(token)
        elif operand and word not in BINDS and ("exception" in word or word in EXCEPTIONS if held and held[-1] == "with" else identifier(name)):
            out.append(word)
            operand = False
        elif not operand and word in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        elif not operand and token == ")" and "(" in held:
            while (top := held.pop()) != "(":
                out.append(top)
        else:
            unread = True
            break
        if token[-1] in ".:-" and not operand:  # the end of a sentence
            break
    while operand and held and held[-1] == "(":
        held.pop()
    if operand and held:  # an operator without its right side
        if held[-1] == "and" and unread:
            out.append("?")
        else:
            held.pop()
    return [*out, *(x for x in reversed(held) if x != "(")] if out else []


def evaluate(tokens: list[str]) -> tuple[float, list[str]]:
    """Restriction of a postfix expression, and its licences."""
    stack: list[tuple[float, list[str]]] = []
    for token in tokens:
        if token not in BINDS:
            stack.append((restriction(token), [token] if token != "?" else []))
            continue
        (right, more), (left, names) = stack.pop(), stack.pop()
        bound = min(left, right) if token == "or" else max(left, right) if token == "and" else left * LOOSENED
        stack.append((bound, names if token == "with" else names + more))
    return stack[-1]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _word_bytes() -> np.ndarray:
    """Byte to its lower-cased word byte, or to a space."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[48:58], table[97:123], table[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)
    return table


def words_of(raw: bytes, table: np.ndarray) -> bytes:
    """The words, each between single spaces."""
    mapped = np.empty(len(raw) + 2, np.uint8)
    mapped[0] = mapped[-1] = 32
    mapped[1:-1] = table[np.frombuffer(raw, np.uint8)]
    space = mapped == 32
    stay = np.ones(len(mapped), bool)
    stay[1:] = ~(space[1:] & space[:-1])
    return mapped[stay].tobytes()


def automaton(entries: list[tuple]):
    """Finds the first of each entry, whose rest is told with its place."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry in entries:
        found.add_word(entry[0], entry)
    found.make_automaton()
    return found


def expressions(text: str, tags) -> list[list[str]]:
    """The postfix expressions behind the tags of a text."""
    lower = text.translate(_LOWER)
    spots: list[tuple[int, int]] = []
    for last, (tag,) in tags.iter(lower):
        begin = last + 1 - len(tag)
        if begin == 0 or not (lower[begin - 1].isalnum() or lower[begin - 1] in "-_"):  # else part of a longer name
            spots.append((begin, last + 1))
    found = []
    for i, (_, begin) in enumerate(spots):
        line = LINE.search(text, begin)
        end = min(line.start() if line else len(text), spots[i + 1][0] if i + 1 < len(spots) else len(text))
        if tokens := postfix(text, begin, end):
            found.append(tokens)
    return found


def scan(docs: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """License evidence of each document (doc_id, text). ``extra``: more phrases (lower-case words) with their labels."""
    phrases = NOTICES | (extra or {}) | BASE
    entries = [(f" {x} ", len(x) + 2, label, x in BASE) for x, label in {**dict.fromkeys(HINTS, ""), **phrases}.items()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        key = ("licenses", tuple(entries))
        if key not in cache:
            cache[key] = automaton(entries), automaton([(x,) for x in TAGS]), _word_bytes()
        machine, tags, table = cache[key]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        names = [x.split()[0] for x in COLUMNS.split(", ")]
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                reduced = words_of(text.encode(), table)
                n_words = max(0, reduced.count(b" ") - 1)
                reduced = reduced.decode()
                starts, base, labels, worst, tagged = [], set(), set(), 0.0, False
                for end, (_, size, label, is_base) in machine.iter(reduced):
                    if is_base:
                        starts.append(end + 1 - size)
                        base.add(label)
                    if label:
                        labels.add(label)
                        worst = max(worst, restriction(label))
                    else:
                        tagged = True
                said = []
                for tokens in expressions(text, tags) if tagged else ():
                    bound, ids = evaluate(tokens)
                    worst = max(worst, bound)
                    labels.update(ids)
                    said.append(" ".join(tokens))
                at = [reduced.count(" ", 0, x) for x in ((min(starts), max(starts)) if starts else ())]
                out.append((doc, n_words, len(starts), *(at or (None, None)), ",".join(sorted(base)), ",".join(sorted(labels)), worst, ";".join(said)))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out) if out else [()] * len(kinds), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, COLUMNS)
