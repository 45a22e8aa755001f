"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Every window of an item (``window`` consecutive words, or the whole item if it
is shorter) is a set of positioned word shingles, ordered by how many documents
hold them.  A document that holds the window holds all its shingles, so the
necessary prefix of the window is its one rarest shingle.  Documents' shingles
meet only these; the shingle's place in the window bounds where the window may
start, its length must fit in the text, and then every word is compared, first by hash and then byte by byte.

The index of the items is broadcast in slices of bounded size: further slices
are further passes over the rows, so neither items nor documents are limited.
The rarity of a shingle is counted over all documents and only affects speed.

Defined results: a null text has no words; an item without words has no
window; an item whose id is null counts under the empty id; repeated rows give
repeated results; only the named columns are read, so others may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as t
from .shared import lean

SLICE_BYTES = 8 << 20  # item text in one broadcast index
SHINGLE = 5


class Index:
    """Distinct windows of some items: words, rarest shingle, and the items that hold each."""

    def __init__(self, ids: list[str], item_texts: list[str], window: int, shingle: int = SHINGLE):
        buf, offs = t.texts(pa.array(item_texts, pa.string()))
        w = t.Words(buf, offs, t.ALNUM)
        count = np.diff(w.first)
        size = np.minimum(count, window)
        n_windows = np.where(count > 0, count - size + 1, 0)
        start = t.ranges(w.first[:-1], n_windows)
        item = np.repeat(np.arange(len(ids)), n_windows)
        k = size[item]
        words, name = np.zeros((len(start), window), np.uint64), np.full((len(start), window), -1)
        names = self._names(w)
        for j in range(window):
            on = j < k
            words[on, j], name[on, j] = w.hash[start[on] + j], names[start[on] + j]
        _, first, which = np.unique(name, axis=0, return_index=True, return_inverse=True) if len(start) else (None, np.zeros(0, int), np.zeros(0, int))
        self.words, self.size = words[first], k[first]
        self.low, self.word_start, self.word_end, self.at = w.low, w.start, w.end, start[first]
        pairs = np.unique(np.column_stack([which.reshape(-1), item]), axis=0) if len(start) else np.zeros((0, 2), int)
        self.items, self.item_start = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.ids, self.shingle = ids, shingle
        self.token, self.offset, self.q = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _names(w: t.Words) -> np.ndarray:
        """A number for each word, alike for equal bytes only."""
        if not len(w):
            return np.zeros(0, np.int64)
        _, first, name = np.unique(w.hash, return_index=True, return_inverse=True)
        one = first[name]
        clash = np.flatnonzero(~t.same_bytes(w.low, w.start, w.end, w.low, w.start[one], w.end[one]))
        more: dict[bytes, int] = {}
        for i in clash.tolist():
            name[i] = more.setdefault(w.low[w.start[i] : w.end[i]].tobytes(), len(first) + len(more))
        return name

    def __len__(self) -> int:
        return len(self.size)

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (window, offset, hash) of the windows' shingles."""
        found = []
        for k in np.unique(self.size):
            at, q = np.flatnonzero(self.size == k), min(self.shingle, k)
            for o in range(k - q + 1):
                h = np.full(len(at), np.uint64(q))
                for j in range(q):
                    h += self.words[at, o + j] * t._SLOT[j]
                found.append((at, np.full(len(at), o), t.mix(h)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def sizes(self) -> list[int]:
        return sorted({min(self.shingle, int(k)) for k in self.size})

    def choose(self, rarity: dict[int, int]) -> None:
        """Keep of each window its rarest shingle; ties go to the smaller hash, then the earlier place."""
        at, offset, h = self.shingles()
        df = np.array([rarity.get(int(x), 0) for x in h.astype(np.int64)], np.int64)
        order = np.lexsort((offset, h, df, at))
        order = order[np.unique(at[order], return_index=True)[1]]
        order = order[np.argsort(h[order], kind="stable")]
        self.token, self.offset, self.window = h[order], offset[order], at[order]
        self.filter = t.Filter(self.token)

    def matches(self, w: t.Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence in the words."""
        got = []
        for q in self.sizes():
            h, pos = t.shingles(w, q)
            near = self.filter(h)
            h, pos = h[near], pos[near]
            a, b = np.searchsorted(self.token, h, "left"), np.searchsorted(self.token, h, "right")
            entry, pos = t.ranges(a, b - a), np.repeat(pos, b - a)
            window, start = self.window[entry], pos - self.offset[entry]
            doc = np.searchsorted(w.first, pos, "right") - 1
            ok = (np.minimum(self.shingle, self.size[window]) == q) & (start >= w.first[doc]) & (start + self.size[window] <= w.first[doc + 1])
            window, start = window[ok], start[ok]
            same = np.ones(len(start), bool)
            for j in range(self.words.shape[1]):
                on = j < self.size[window]
                same[on] &= self.words[window[on], j] == w.hash[start[on] + j]
            window, start = window[same], start[same]
            same = np.ones(len(start), bool)
            for j in range(self.words.shape[1]):
                on = np.flatnonzero(j < self.size[window])
                a, b = start[on] + j, self.at[window[on]] + j
                same[on] &= t.same_bytes(w.low, w.start[a], w.end[a], self.low, self.word_start[b], self.word_end[b])
            got.append((window[same], start[same]))
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])


def _rarity(docs: DataFrame, text: str, index: Index) -> dict[int, int]:
    """In how many texts each shingle of the index occurs."""
    keys = np.unique(index.shingles()[2])
    shared = docs.sparkSession.sparkContext.broadcast((keys, t.Filter(keys), index.sizes()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, keep, sizes = shared.value
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            buf, offs = t.texts(batch.column(0))
            for a, b in t.chunks(offs):
                w = t.Words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], t.ALNUM)
                seen = []
                for q in sizes:
                    h, pos = t.shingles(w, q)
                    near = keep(h)
                    at = np.searchsorted(keys, h[near])
                    ok = keys[np.minimum(at, len(keys) - 1)] == h[near]
                    doc = np.searchsorted(w.first, pos[near][ok], "right") - 1
                    seen.append(doc * len(keys) + at[ok])
                total += np.bincount(np.unique(np.concatenate(seen)) % len(keys), minlength=len(keys))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[on].view(np.int64)), pa.array(total[on])], ["token", "n"])

    if not len(keys):
        return {}
    rows = docs.select(F.col(text).cast("string")).mapInArrow(lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in rows}


def _match(docs: DataFrame, text: str, index: Index) -> DataFrame:
    """Append the slice's hits to the rows' ``runs`` (first word, length) and ``items``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            buf, offs = t.texts(batch.column(k))
            for a, b in t.chunks(offs):
                w = t.Words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], t.ALNUM)
                window, start = index.matches(w)
                doc = np.searchsorted(w.first, start, "right") - 1
                order = np.argsort(doc, kind="stable")
                window, start, doc = window[order], start[order], doc[order]
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                part = batch.slice(a, b - a)
                runs, items = part.column("runs").to_pylist(), part.column("items").to_pylist()
                for i in np.unique(doc):
                    lo, hi = cut[i], cut[i + 1]
                    s = start[lo:hi] - w.first[i]
                    runs[i] = runs[i] + np.unique(np.column_stack([s, index.size[window[lo:hi]]]), axis=0).ravel().tolist()
                    hit = np.unique(window[lo:hi])
                    held = index.items[t.ranges(index.item_start[hit], index.item_start[hit + 1] - index.item_start[hit])]
                    items[i] = sorted({*items[i], *(index.ids[x] for x in held)})
                columns = {n: part.column(n) for n in part.schema.names} | {"n_words": pa.array(np.diff(w.first)), "runs": pa.array(runs, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(lean(run), docs.schema)


def slices(items: DataFrame, item_id: str, text: str, window: int, slice_bytes: int) -> Iterator[Index]:
    """Indexes of parts of the items, none of which holds much more text than a slice."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-size // slice_bytes))
    for k in range(n):
        part = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("body"), F.lit(n)) == k)).collect()
        index = Index([r.item for r in part], [r.body for r in part], window)
        if len(index):
            yield index


def overlaps(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = 13, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``docs`` (columns ``keep`` and ``text``) with ``n_words``, ``runs`` (flat pairs of first word and length
    of each occurrence) and ``items`` (sorted ids of the items that occur)."""
    kept = dict.fromkeys((*keep, text))
    rows = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("runs"), F.array().cast("array<string>").alias("items"))
    at = [index for index in slices(items, item_id, item_text, window, slice_bytes)] or [Index([], [], window)]
    for index in at:
        index.choose(_rarity(docs, text, index))
        rows = _match(rows, text, index)
    return rows


def report(rows: DataFrame) -> DataFrame:
    """Counts and verdict for each row of :func:`overlaps`; contaminated means at least one word in twenty was hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = batch.column("n_words").to_numpy()
            n_hit = np.zeros(len(n_words), np.int64)
            items = batch.column("items").to_pylist()
            for i, r in enumerate(batch.column("runs").to_pylist()):
                end = -1
                for s, k in sorted(zip(r[::2], r[1::2], strict=True)):
                    n_hit[i] += max(0, s + k - max(s, end))
                    end = max(end, s + k)
            new = {"n_hit": pa.array(n_hit), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array([t.hex_digest(",".join(x)) for x in items]), "contaminated": pa.array((n_hit > 0) & (20 * n_hit >= n_words))}
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names if n != "runs"} | new)

    kept = [f for f in rows.schema.fields if f.name not in ("runs",)]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(lean(run), f"{names}, n_hit long, n_items long, items_sha256 string, contaminated boolean")
