"""Quality classifier: gated attention over a document's passages.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from what
its characters and words are like (shares of character classes, word sizes, repetition; never
language, source or id), a small layer maps it on, and a gated attention unit,
tanh(hV) * sigmoid(hU), learns from document labels alone which passages matter; the weighted
sum of passages is scored by a logistic unit (Ilse, Tomczak and Welling 2018).

The model is fitted on the driver, on a bounded sample of labelled documents: the ``TRAIN_DOCS`` with the least hashes
of their ids and, in that order, those whose passages still fit into ``TRAIN_PASSAGES`` in all. Every passage of a document of
the sample is in its bag, however long the text. Scoring reads every passage of every document, slice by slice of a partition.

Null, empty and blank texts have no passages and get the score of an empty bag. Labels that are null or
contradict each other aren't learned from; without any labels, all scores are 0.5. Of texts that share an id, the one with the
least hash is learned from. Repeated rows repeat their score; extra columns are
ignored, whatever their names; an empty table gives no rows. A very long text is encoded at once, in some tens of bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import keep

PASSAGE, TRAIN_DOCS, TRAIN_PASSAGES = 64, 4000, 400_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 60, 256, 0.01, 1e-4
#: Bytes of text that are encoded at a time.
SLICE = 1 << 20
#: Character classes, by bytes; the last takes bytes beyond ASCII.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"'\"()[]{}-_/\\@+=~^`")
WIDTH = len(CLASSES) + 1 + 7


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, features) of every passage of ``texts``."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.int64), np.empty((0, WIDTH))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    owner = np.searchsorted(first, starts, "right") - 1
    n = np.arange(len(starts)) - np.searchsorted(owner, owner)
    opens = np.flatnonzero((n % PASSAGE == 0))
    count = np.diff(opens, append=len(starts))
    kind = np.full(256, len(CLASSES), np.int64)
    kind[:128] = len(CLASSES) + 1
    for i, chars in enumerate(CLASSES):
        kind[list(chars)] = i
    passage = np.repeat(np.arange(len(opens)), count)
    # Bytes between a passage's first and the next one's are its own.
    begin = starts[opens]
    of = np.repeat(np.arange(len(opens)), np.diff(begin, append=len(data)))
    body = kind[data[begin[0] :]]
    table = np.bincount(of * (len(CLASSES) + 2) + body, minlength=len(opens) * (len(CLASSES) + 2)).reshape(len(opens), -1)[:, : len(CLASSES) + 1]
    size = (ends - starts).astype(float)
    chars = np.maximum(np.add.reduceat(size, opens), 1)
    # Capital letters of Latin-1, two bytes in UTF-8.
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    capitals = np.bincount(of, weights=capital[begin[0] :], minlength=len(opens))
    lines = np.bincount(of, weights=data[begin[0] :] == 10, minlength=len(opens))
    # Distinct words of a passage, by a hash of ends, length and sum of bytes.
    plain = np.concatenate([[0], np.cumsum(data.astype(np.int64) ** 2)])
    word = (plain[ends] - plain[starts]) * 1_000_003 + data[starts].astype(np.int64) * 8191 + data[ends - 1].astype(np.int64) * 131 + size.astype(np.int64)
    order = np.lexsort((word, passage))
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order], weights=fresh, minlength=len(opens))
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])
    mean = chars / count
    spread = np.sqrt(np.maximum(np.add.reduceat(size**2, opens) / count - mean**2, 0))
    more = [capitals / chars, lines / count, distinct / count, np.add.reduceat(again, opens) / count, mean / 10, spread / 10, np.log1p(count) / 5]
    return owner[opens], np.column_stack([table / chars[:, None], *more])


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    texts, begin, held = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
        held += len(texts[-1])
        if held >= SLICE:
            yield begin, texts
            texts, begin, held = [], i + 1, 0
    if texts:
        yield begin, texts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Model:
    """Encoder, gated attention and output unit."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        glorot = lambda a, b: r.normal(0, np.sqrt(2 / (a + b)), (a, b))
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {"W": glorot(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": glorot(HIDDEN, GATE), "U": glorot(HIDDEN, GATE), "w": glorot(GATE, 1)[:, 0], "c": glorot(HIDDEN, 1)[:, 0], "d": np.zeros(1)}

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
        """``bag``: sorted bag numbers below ``n`` of the passages ``x``."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = np.exp(np.clip((t * g) @ p["w"], -30, 30))
        a = e / np.maximum(np.bincount(bag, weights=e, minlength=n), 1e-30)[bag]
        z = np.zeros((n, HIDDEN))
        np.add.at(z, bag, a[:, None] * h)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, bag, len(y))
        out = (f["score"] - y) / len(y)
        into = out[:, None] * p["c"]  # by z
        to_a = (into[bag] * f["h"]).sum(1)
        to_e = f["a"] * (to_a - np.bincount(bag, weights=f["a"] * to_a, minlength=len(y))[bag])
        to_tg = to_e[:, None] * p["w"]
        to_t, to_g = to_tg * f["g"] * (1 - f["t"] ** 2), to_tg * f["t"] * f["g"] * (1 - f["g"])
        to_h = f["a"][:, None] * into[bag] + to_t @ p["V"].T + to_g @ p["U"].T
        to_h = to_h * (f["h"] > 0)
        return {"W": f["x"].T @ to_h, "b": to_h.sum(0), "V": f["h"].T @ to_t, "U": f["h"].T @ to_g, "w": (f["t"] * f["g"]).T @ to_e, "c": f["z"].T @ out, "d": np.array([out.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 5) -> "Model":
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), np.maximum(every.std(0), 1e-3)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.p["d"][:] = np.log(share / (1 - share))
        r, m, v, step = np.random.default_rng(seed), {k: 0 * x for k, x in self.p.items()}, {k: 0 * x for k, x in self.p.items()}, 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = r.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                bag = np.repeat(np.arange(len(some)), [len(bags[j]) for j in some])
                step += 1
                for k, g in self.gradient(np.concatenate([bags[j] for j in some]), bag, y[some]).items():
                    g = g + DECAY * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """A model from the documents (doc_id, text) with labels (doc_id, 0 or 1) that aren't held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min(label).alias("least"), F.max(label).alias("y")).where("least = y").select("doc_id", "y")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)  # at most TRAIN_DOCS rows: bounded
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").withColumn("digest", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch, 1):
                owner, x = passages(texts)
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                sets = [x[a:b].astype(np.float32).tobytes() for a, b in zip(bounds, bounds[1:])]
                some = [batch.column(i).slice(begin, len(texts)) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*some, pa.array(np.diff(bounds)), pa.array(sets, pa.binary())], ["doc_id", "y", "digest", "n", "x"])

    bags = rows.select("doc_id", "text", F.col("y").cast("int"), "digest").mapInArrow(encode, "doc_id long, y int, digest long, n long, x binary").where("n > 0")
    bags, drop = keep(bags.groupBy("doc_id").agg(F.min_by(F.struct("y", "n", "x"), "digest").alias("bag")).select("doc_id", "bag.*"))
    fitting, room = [], TRAIN_PASSAGES
    for r in bags.select("doc_id", "n", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():  # at most TRAIN_DOCS rows
        if r.n <= room:
            fitting.append(r.doc_id)
            room -= r.n
    got = bags.where(F.col("doc_id").isin(fitting)).collect() if fitting else []  # at most TRAIN_PASSAGES passages
    drop()
    if not got:
        return None
    got.sort(key=lambda r: r.doc_id)
    return Model().fit([np.frombuffer(r.x, np.float32).reshape(-1, WIDTH).astype(float) for r in got], np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every document (doc_id, text)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch, 1):
                if model is None:
                    values = np.full(len(texts), 0.5)
                else:
                    owner, x = passages(texts)
                    values = model.forward(x, owner, len(texts))["score"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(values)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
