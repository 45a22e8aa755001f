"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few shape features (shares of letter case, signs, repeated
words and lines, lengths).  Features are cut into quantile bins.  Cyclic
boosting then visits the features in turn: each visit fits a shallow tree to
the current gradient over one feature's bins and adds it, damped, to that
feature's lookup table.  The pairs that explain most of what is left get
two-dimensional tables in the same way.  A score is the logistic function of an
intercept plus one table entry per feature and pair.

Training uses at most ``sample`` labelled rows, those with the smallest hash of
their id; everything else covers all rows.  Labels, language, source and id are
never inputs of a score.

Defined results: null and empty texts are scored by the features of an empty
text; without labelled rows of both classes every score is the share of ones,
or 0.5 without any; repeated rows are scored alike; rows whose label is null
are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .shared import lean

SAMPLE = 8000
BINS = 24
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 6
PAIR_BINS = 8
RATE = 0.15

FEATURES = ("bytes", "words", "word_bytes", "upper", "signs", "digits", "other", "distinct", "twins", "sign_ends", "line_bytes", "distinct_lines", "long_words", "top_word", "stops")


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    per_byte = np.maximum(size, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[offs[1:]] - total[offs[:-1]]).astype(float)

    w = t.Words(buf, offs, t.NON_SPACE)
    doc, words = w.text_of(), np.diff(w.first).astype(float)
    per_word = np.maximum(words, 1)
    upper = (buf >= 65) & (buf <= 90)
    lower = (buf >= 97) & (buf <= 122)
    digit = (buf >= 48) & (buf <= 57)
    sign = (buf > 32) & (buf < 127) & ~upper & ~lower & ~digit
    line_end = buf == 10

    def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values and the most frequent one's count, by text."""
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, doc[at], np.diff(np.append(at, len(h))))
        return np.bincount(doc[at], minlength=n).astype(float), most

    kinds, most = distinct(w.hash, doc)
    twin = np.zeros(len(w), bool)
    twin[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    length = (w.end - w.start).astype(float)
    by_doc = lambda x: np.bincount(doc, weights=x.astype(float), minlength=n)
    is_line = np.ones(256, bool)
    is_line[10] = False
    lines = t.Words(buf, offs, is_line)
    n_lines = np.diff(lines.first).astype(float)
    line_kinds, _ = distinct(lines.hash, lines.text_of())
    return np.column_stack([
        np.log1p(size), np.log1p(words), by_doc(length) / per_word, count(upper) / per_byte, count(sign) / per_byte, count(digit) / per_byte, count(buf > 127) / per_byte, kinds / per_word * np.log1p(words), by_doc(twin) / per_word,
        by_doc(sign[w.end - 1]) / per_word, np.log1p(size / (count(line_end) + 1)), line_kinds / np.maximum(n_lines, 1), by_doc(length > 12) / per_word, most / per_word, count(buf == 46) / per_word,
    ])


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A shallow tree over ordered bins with gradient and curvature sums; returns its value in each bin."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a**2 / (b + 1.0) + (g.sum() - a) ** 2 / (h.sum() - b + 1.0)
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + 1.0) + 1e-9:
            out[:k], out[k:] = _tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One cut along the better axis, then a cut of each side along the other."""
    best, out = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        a, b = np.cumsum(gg.sum(1))[:-1], np.cumsum(hh.sum(1))[:-1]
        if not len(a):
            continue
        k = int(np.argmax(a**2 / (b + 1.0) + (g.sum() - a) ** 2 / (h.sum() - b + 1.0))) + 1
        grid = np.zeros_like(gg)
        for part in (slice(0, k), slice(k, None)):
            grid[part] = _tree(gg[part].sum(0), hh[part].sum(0), 1)
        gain = float((2 * grid * gg - grid**2 * (hh + 1e-9)).sum())
        if gain > best:
            best, out = gain, grid if axis == 0 else grid.T
    return out


class Model:
    """Bin edges, lookup tables of features and of pairs, and the intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS, rate: float = RATE):
        share = float(y.mean()) if len(y) else 0.5
        self.constant = share if share in (0.0, 1.0) or not len(y) else None
        self.pairs: list[tuple[int, int]] = []
        self.edges, self.tables, self.coarse, self.grids = [], [], [], []
        self.intercept = 0.0 if self.constant is not None else float(np.log(share / (1 - share)))
        if self.constant is not None:
            return
        d = x.shape[1]
        self.edges = [_edges(x[:, j], bins) for j in range(d)]
        self.coarse = [_edges(x[:, j], PAIR_BINS) for j in range(d)]
        fine, rough = self._bin(x, self.edges), self._bin(x, self.coarse)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.intercept)

        def gradient() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(rounds):
            for j in range(d):
                g, h = gradient()
                k = len(self.tables[j])
                step = rate * np.clip(_tree(np.bincount(fine[j], g, k), np.bincount(fine[j], h, k), 2), -4, 4)
                self.tables[j] += step
                f += step[fine[j]]

        def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            g, h = gradient()
            cell = rough[i] * b + rough[j]
            return cell, np.bincount(cell, g, a * b).reshape(a, b), np.bincount(cell, h, a * b).reshape(a, b)

        def gain(i: int, j: int) -> float:
            _, g, h = sums(i, j)
            grid = _tree2(g, h)
            return float((2 * grid * g - grid**2 * h).sum())

        every = [(i, j) for i in range(d) for j in range(i)]
        self.pairs = sorted(every, key=lambda p: (-gain(*p), p))[:pairs]
        self.grids = [np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for i, j in self.pairs]
        for _ in range(pair_rounds):
            for k, (i, j) in enumerate(self.pairs):
                cell, g, h = sums(i, j)
                step = rate * np.clip(_tree2(g, h), -4, 4)
                self.grids[k] += step
                f += step.ravel()[cell]

    @staticmethod
    def _bin(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Table entries added up, one gather per feature and pair."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        f = np.full(len(x), self.intercept)
        for table, at in zip(self.tables, self._bin(x, self.edges), strict=True):
            f += table[at]
        rough = self._bin(x, self.coarse)
        for grid, (i, j) in zip(self.grids, self.pairs, strict=True):
            f += grid[rough[i], rough[j]]
        return 1 / (1 + np.exp(-f))


def _features_of(column: pa.Array) -> np.ndarray:
    buf, offs = t.texts(column)
    parts = [features(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in t.chunks(offs)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def chosen(labels: DataFrame, label: str, learn: Column, sample: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``sample`` labelled rows that may be learned from, by the smallest hash of their id."""
    rows = labels.where(learn & F.col(label).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    return rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)


def train(docs: DataFrame, labels: DataFrame, *, learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    rows = chosen(labels, label, learn, sample, doc_id)
    # at most ``sample`` small rows, so the broadcast is bounded
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(rows), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features_of(batch.column("_text"))
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id").cast(pa.string()), "y": batch.column("_y"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    # rows of one id are one row, the least, so what comes to the driver is bounded
    got = found.mapInArrow(lean(run), "_id string, y int, x array<double>").groupBy("_id").agg(F.min(F.struct("y", "x")).alias("r")).select("_id", "r.*").collect()
    got.sort(key=lambda r: (r._id or "", r.y, r.x))
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    return Model(x, np.array([r.y for r in got], float))


def scored(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score)
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = shared.value.score(_features_of(batch.column(k)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, score])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lean(run), f"{kept}, `{score}` double")
