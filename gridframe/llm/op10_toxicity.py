"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5 bytes, with word ends
marked) hashed to ``buckets`` rows of an embedding.  The average of the bag goes
into a linear softmax of two classes, so an unseen misspelling still shares
most of its word's vector.  The softmax odds of a text's words are added up
(multiple-instance learning: a text is toxic because of some of its words), so
a long text does not dilute a few words.  Embedding and softmax are trained
together by Adam with weight decay; a text's gradient is shared among its words
in proportion to their odds.

As everything up to the softmax is linear, scoring needs just one number per
bucket: the difference of its two logits.

Training uses at most ``sample`` labelled rows of at most ``sample_bytes`` each
(longer ones are not learned from); every whole text is scored.

Defined results: a text without words gets the score of the bias alone; without
labelled rows of both classes every score is the share of ones, 0 without any;
repeated rows are scored alike; null texts count as empty; of labelled rows of one id
the least by label and text is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .op3_quality import chosen

SAMPLE = 3000
SAMPLE_BYTES = 12_000
BUCKETS = 1 << 18
DIM = 8
STEPS = 50
RATE = 0.05
DECAY = 0.01
BIAS = -9.0  # log odds of a word to begin with
NGRAMS = (3, 4, 5)


def subwords(buf: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, and where each word's begin; words come as byte ranges."""
    size = end - start
    padded = np.zeros(int((size + 2).sum()), np.uint64)
    first = np.cumsum(size + 2) - (size + 2)
    padded[t.ranges(first + 1, size)] = buf[t.ranges(start, size)]
    padded[first], padded[first + size + 1] = 300, 301
    word = np.repeat(np.arange(len(size)), size + 2)
    values = t.mix(padded + np.uint64(77))
    grams, owner = [], []
    for n in NGRAMS:
        if len(values) >= n:
            h = t.sequence_hash(values, n)
            ok = np.flatnonzero(word[n - 1 :] == word[: len(word) - n + 1])
            grams.append((h[ok] >> np.uint64(20)).astype(np.int64) % buckets)
            owner.append(word[ok])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return grams[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


class Bags:
    """Distinct words of some texts as subwords, and the texts as positions of these."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS):
        w = t.Words(buf, offs, t.ALNUM)
        _, at, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        self.first = w.first
        self.grams, self.start = subwords(w.low, w.start[at], w.end[at], buckets)
        self.count = np.diff(self.start)

    def word_scores(self, of_bucket: np.ndarray) -> np.ndarray:
        total = np.append(0.0, np.cumsum(of_bucket[self.grams]))
        return (total[self.start[1:]] - total[self.start[:-1]]) / np.maximum(self.count, 1)

    def pooled(self, of_bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the log of its words' summed odds (0 without words); which text and what share of its odds each word has."""
        s = self.word_scores(of_bucket)[self.word]
        n = np.diff(self.first)
        has = np.flatnonzero(n)
        text = np.repeat(np.arange(len(n)), n)
        out = np.zeros(len(n))
        if not len(has):
            return out, text, s
        most, total = np.zeros(len(n)), np.ones(len(n))
        most[has] = np.maximum.reduceat(s, self.first[has])
        s = np.exp(s - most[text])
        total[has] = np.add.reduceat(s, self.first[has])
        out[has] = most[has] + np.log(total[has])
        return out, text, s / total[text]


class Model:
    def __init__(self, bags: Bags | None, y: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, steps: int = STEPS):
        share = float(y.mean()) if len(y) else 0.0
        self.bias, self.of_bucket = BIAS, np.zeros(buckets)
        self.constant = share if share in (0.0, 1.0) else None
        if self.constant is not None:
            return
        used, grams = np.unique(bags.grams, return_inverse=True)
        known = Bags.__new__(Bags)  # the same bags, over the buckets in use
        known.word, known.first, known.grams, known.start, known.count = bags.word, bags.first, grams, bags.start, bags.count
        rng = np.random.default_rng(7)
        e, v, bias = rng.normal(0, 0.05, (len(used), dim)), rng.normal(0, 0.5, (dim, 2)), np.array([0.0, BIAS])
        params = [e, v, bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        weight = np.where(y > 0, share**-0.5, (1 - share) ** -0.5)
        weight /= weight.sum()
        for step in range(1, steps + 1):
            d = v[:, 1] - v[:, 0]
            logit, text, part = known.pooled(e @ d)
            g = (1 / (1 + np.exp(-(logit + bias[1] - bias[0]))) - y) * weight
            per_word = np.bincount(known.word, g[text] * part, len(known.count)) / np.maximum(known.count, 1)
            gs = np.bincount(grams, np.repeat(per_word, known.count), len(used))
            gv = e.T @ gs
            grads = [np.outer(gs, d), np.column_stack([-gv, gv]), np.array([-g.sum(), g.sum()])]
            for p, (m, s), grad in zip(params, moments, grads, strict=True):
                m += 0.1 * (grad - m)
                s += 0.01 * (grad**2 - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
            e *= 1 - DECAY
        self.of_bucket[used], self.bias = e @ (v[:, 1] - v[:, 0]), float(bias[1] - bias[0])

    def score(self, bags: Bags) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags.first) - 1, self.constant)
        return 1 / (1 + np.exp(-(bags.pooled(self.of_bucket)[0] + self.bias)))


def train(docs: DataFrame, labels: DataFrame, *, learn: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    rows = chosen(labels, label, learn, sample, doc_id)
    # at most ``sample`` small rows, so the broadcast is bounded
    found = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).where(F.octet_length("_text") <= sample_bytes).join(F.broadcast(rows), "_id")
    # rows of one id are one row, the least, so what comes to the driver is bounded
    got = found.groupBy(F.col("_id").cast("string").alias("_id")).agg(F.min(F.struct("_y", "_text")).alias("r")).select("_id", "r.*").collect()
    got.sort(key=lambda r: (r._id or "", r._y, r._text))
    y = np.array([r._y for r in got], float)
    return Model(Bags(*t.texts(pa.array([r._text for r in got], pa.string()))) if got else None, y)


def scored(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score)
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = t.texts(batch.column(k))
            value = [shared.value.score(Bags(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])) for a, b in t.chunks(offs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(value) if value else np.zeros(0))], names=[*batch.schema.names, score])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kept}, `{score}` double")
