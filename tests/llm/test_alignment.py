"""Token alignment against all pairs of tokens, text by text."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "text string, doc_id long, side int"
TEXTS = [
    None, "", " ", "   ", "a", "Hello world, again and again.", "  two  spaces   and more ", "line\nbreaks\r\n\ttabs\n\n", "ünïcödé Ünïversität größer İıŞ", "日本語のテキスト 漢字",
    "emoji 👩‍👩‍👧 \U0001f600", "<|endoftext|> <s> </s> <0x0A> <unk>", "a ▁ b", "x" * 300, "zero​width space", "ﬁ ligature", "\x00nul", "The cat sat on the mat. " * 40, "The cat sat on the mat. " * 40,
]


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    done, count = [], Counter()
    for text, doc, _ in rows:
        told = None
        if text:
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            raw = [[bytes(shown[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
            if b"".join(raw[0]) == b"".join(raw[1]) == (" " + text).encode():
                spans = [[], []]
                for side in (0, 1):
                    at = 0
                    for i, x in zip(ids[side], raw[side]):
                        spans[side].append((at, at + len(x), i))
                        at += len(x)
                links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
                common = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
                groups, low = [], 0
                for end in common:
                    groups.append("|".join(",".join(str(i) for s, e, i in spans[side] if low <= s and e <= end) for side in (0, 1)))
                    low = end
                told = len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
                count.update(links)
        done.append((doc, told))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    for doc, told in done:
        if told is None:
            yield doc, 0, 0, 0, 0, 0, 0, ""
        else:
            n_a, n_b, n, links, digest = told
            yield doc, n_a, n_b, n, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest


@pytest.mark.parametrize("hot,block", [(100_000, 8192), (20, 3), (1, 1)])
def test_all_pairs(spark, monkeypatch, hot, block):
    monkeypatch.setattr(alignment, "HOT", hot)
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows = [(t, i if i != 5 else None, 0) for i, t in enumerate(TEXTS)]
    found = alignment.align(spark.createDataFrame(rows, SCHEMA), A, B)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 4000)
    rows = [(r.text, r.doc_id, 0) for r in docs.collect()]
    assert sorted(map(tuple, alignment.align(docs, A, B).collect())) == sorted(brute(rows))


def test_a_very_long_text_and_no_rows(spark):
    text = "The quick brown fox, again. " * 40_000
    row = alignment.align(spark.createDataFrame([(text, 1, 0)], SCHEMA), A, B).first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_a > 10 * alignment.BLOCK
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_units_as_the_model_gives_them():
    """Words behind one space by merges of ranks, other units encoded together: as the model encodes the whole text, with what one text leaves for the next. (A text that holds the mark itself has no tokens.)"""
    pieces = alignment.Pieces(B)
    assert pieces.fast is not None
    r = random.Random(2)
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 200))) for letters in ("aeinorst .\n", "ab  \t", "the <s>0x41é", "".join(map(chr, range(1, 128)))) for _ in range(200)]
    texts += [" ", "a ", " a", "x" * 3000, "a" * 50 + "  b", "日本語  テキスト 😀", "é " * 300]
    for text in texts:
        assert pieces(text).tolist() == pieces.model.encode(text), text
    pieces.fast = None
    units = list(dict.fromkeys(u for text in texts for u in re.findall(" +[^ ]*", " " + text)))
    for i in range(0, len(units), 70):
        assert all(np.frombuffer(ids, "<u4").tolist() == pieces.unit(u) for u, ids in pieces.units(units[i : i + 70]).items())
    for text in texts:
        assert pieces(text).tolist() == pieces.model.encode(text), text
