"""Repeated byte strings: every byte covered by a string of ``length`` bytes that starts anywhere else too.

Positions meet by content.  Each string of ``length`` bytes has an anchor: the
place of its least ``GRAM``-byte hash, which depends on the string alone.  So
equal strings have equal grams at equal places, and all strings anchored at one
place share one context.  Anchors whose gram occurs once are done; the contexts
of the others are dealt to buckets by gram.

In a bucket, contexts to the right of the anchors are strings of 16-byte
symbols.  Shards of these get their Burrows-Wheeler transforms, which are merged by
interleave refinement (see ``bwt``): the merge gives the order of all contexts and
what neighbours have in common, without sorting suffixes again.  Contexts to the left
are merged likewise, read backwards.  A string that begins ``a`` bytes before its
anchor repeats if two contexts lie in one interval of at least ``a`` common bytes to
the left and ``length - a`` to the right; all ``a`` are tried.

A gram with more than ``hot`` anchors would be too much for one task.  Its strings are
cut into slices of SLICE neighbouring ``a``, which share all but 2 * SLICE bytes; a digest of
the shared bytes takes the gram's place.  Slices that occur once are done.  Only if a slice is
still hot are its strings themselves grouped by digest, counted with partial sums.

Apart from bytes, passages are found: runs of PASSAGE words (white space aside, A-Z in lower case) that another text
holds too, however few bytes they have.  Again each run of words has an anchor; only runs whose anchor is shared are
compared, by 64-bit hashes.

Defined results: a null text is empty; a text that occurs in two rows is
repeated as a whole if it has ``length`` bytes; strings never cross texts; overlaps
within one text count; ids may repeat or be null; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from . import textops as t
from .shared import discard, stored

LENGTH = 400
GRAM = 64
BUCKET = 12_000  # anchors in a bucket
HOT = 40_000  # anchors of one gram that one task may hold
SLICE = 32
PASSAGE = 50  # words of the shortest passage
SHINGLE = 8  # words of a passage's anchor
PIECE = 4 << 20  # a longer text is searched piece by piece
BROADCAST_ROWS = 100_000


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, gram's hash, place, first and last start) of all strings of the texts, by anchor; places count within each text."""
    found = []
    # texts in pieces that overlap so that each string lies in one
    for a, b in t.chunks(offs):
        if offs[b] - offs[a] > PIECE:
            lows = range(int(offs[a]), max(int(offs[b]) - length + 1, int(offs[a]) + 1), PIECE)
            parts = [(lo, min(lo + PIECE + length - 1, int(offs[b])), np.array([a]), np.array([lo, min(lo + PIECE + length - 1, int(offs[b]))])) for lo in lows]
        else:
            parts = [(int(offs[a]), int(offs[b]), np.arange(a, b), offs[a : b + 1])]
        for lo, hi, doc, o in parts:
            n = hi - lo
            if n < length:
                continue
            power, inverse = t.powers(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(t._BYTE_VALUE[buf[lo:hi]] * power[:n], out=total[1:])
            h = t.mix((total[gram:] - total[: n - gram + 1]) * inverse[: n - gram + 1])
            w = length - gram + 1
            # least of each w neighbours: place in the low bits, so the leftmost of equal hashes counts
            key = (h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64)
            pad = -len(key) % w
            rows = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
            ahead = np.minimum.accumulate(rows, axis=1).ravel()
            behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            count = len(h) - w + 1
            best = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & np.uint64((1 << 23) - 1)).astype(np.int64)
            size = np.diff(o)
            starts = np.maximum(0, size - length + 1)
            s = t.ranges(o[:-1] - lo, starts)
            if not len(s):
                continue
            owner = np.repeat(doc, starts)
            p = best[s]
            new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (owner[1:] != owner[:-1])))
            last = np.append(new[1:], len(s)) - 1
            base = offs[owner[new]] - lo
            found.append((owner[new], h[p[new]].view(np.int64), p[new] - base, s[new] - base, s[last] - base))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def least_places(key: np.ndarray, w: int) -> np.ndarray:
    """Where the least of each w neighbours is; keys are distinct."""
    pad = -len(key) % w
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key) + pad, np.int64)
    rank[order], rank[len(key) :] = np.arange(len(key)), len(key)
    rows = rank.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(key) - w + 1
    return order[np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])]


def word_anchors(w: t.Words) -> tuple[np.ndarray, ...]:
    """(text, anchor's hash, first and last run) of all runs of PASSAGE words; a run is named by its first word in its text."""
    runs = np.maximum(0, np.diff(w.first) - PASSAGE + 1)
    s = t.ranges(w.first[:-1], runs)
    if not len(s):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h = t.sequence_hash(w.hash, SHINGLE)
    p = least_places(h, PASSAGE - SHINGLE + 1)[s]
    owner = np.repeat(np.arange(len(runs)), runs)
    new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (owner[1:] != owner[:-1])))
    last = np.append(new[1:], len(s)) - 1
    base = w.first[owner[new]]
    return owner[new], h[p[new]].view(np.int64), s[new] - base, s[last] - base


def _signatures(docs: DataFrame, length: int) -> DataFrame:
    """Per row: id, digest, size, number of words, and the anchors (only at a text's first row in each partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            buf, offs = t.texts(batch.column("text"))
            for a, b in t.chunks(offs):
                o = offs[a : b + 1] - offs[a]
                w = t.Words(buf[offs[a] : offs[b]], o, t.NON_SPACE)
                keys = batch.column("key").slice(a, b - a)
                twin = np.zeros(b - a, bool)
                for i, k in enumerate(keys.to_pylist()):
                    k = bytes.fromhex(k)
                    twin[i] = k in seen
                    seen.add(k)
                lists = []
                for doc, gram, *places in (anchors(buf[offs[a] : offs[b]], o, length), word_anchors(w)):
                    cut = np.searchsorted(doc, np.arange(b - a + 1))
                    count = np.where(twin, 0, np.diff(cut))
                    take = t.ranges(cut[:-1], count)
                    ends = pa.array(np.append(0, np.cumsum(count)), pa.int32())
                    lists += [pa.ListArray.from_arrays(ends, pa.array(x[take], kind)) for x, kind in ((gram, pa.int64()), *((x, pa.int32()) for x in places))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), keys, pa.array(np.diff(o)), pa.array(np.diff(w.first)), *lists], ["id", "key", "n_bytes", "n_words", "gram", "place", "lo", "hi", "word_gram", "first", "last"])

    return docs.mapInArrow(run, "id string, key string, n_bytes long, n_words long, gram array<long>, place array<int>, lo array<int>, hi array<int>, word_gram array<long>, first array<int>, last array<int>")


def _passages(one: DataFrame, body_of: DataFrame) -> DataFrame:
    """(key, n_passage_words) of the texts that hold a run of PASSAGE words of another text, in a stored table; ``one`` has the word anchors
    of each text, ``body_of`` its rows."""
    each = one.select("key", "id", F.explode(F.arrays_zip("word_gram", "first", "last")).alias("x")).select("key", "id", "x.*")
    often = stored(each.groupBy("word_gram").agg(F.count("*").alias("n")).where("n > 1").select("word_gram"), "often")
    shared = each.join(often, "word_gram").groupBy("key", "id").agg(F.collect_list(F.struct("first", "last")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = t.texts(batch.column("text"))
            found = batch.column("found")
            flat, n = found.flatten(), found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.append(0, np.cumsum(n))
            first, last = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last"))
            key = np.array([int(k[:16], 16) for k in batch.column("key").to_pylist()], np.uint64).view(np.int64)
            for a, b in t.chunks(offs):
                w = t.Words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], t.NON_SPACE)
                at, owner = slice(cut[a], cut[b]), np.repeat(np.arange(a, b), n[a:b])
                place = t.ranges(first[at], last[at] - first[at] + 1)
                owner = np.repeat(owner, last[at] - first[at] + 1)
                h = t.sequence_hash(w.hash, PASSAGE)[w.first[owner - a] + place]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[owner]), pa.array(place, pa.int32())], ["h", "k", "place"])

    runs = stored(body_of.join(shared, ["key", "id"]).select("key", "text", "found").mapInArrow(run, "h long, k long, place int"), "runs")
    twice = stored(runs.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("h"), "twice")
    places = runs.join(twice, "h").groupBy("k").agg(F.sort_array(F.collect_list("place")).alias("places"))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    words = F.aggregate("places", none, lambda x, p: F.struct((p + PASSAGE).alias("end"), (x["n"] + PASSAGE - F.greatest(F.lit(0), x["end"] - p)).alias("n")))["n"]
    half = F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.conv(F.substring("key", 9, 8), 16, 10).cast("long")
    named = one.select("key", F.shiftleft(half[0], 32).bitwiseOR(half[1]).alias("k"))
    out = stored(named.join(places.select("k", words.alias("n_passage_words")), "k").select("key", "n_passage_words"), "passages")
    for x in (often, runs, twice):
        discard(x)
    return out


def _contexts(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """The bytes around each shared anchor; for hot grams, of each slice of its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = t.texts(batch.column("text"))
            keys, found = batch.column("key"), batch.column("found")
            flat = found.flatten()
            ends = np.append(0, np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False)))
            gram, place, lo, hi, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("gram", "place", "lo", "hi", "hot"))
            out: list[tuple] = []
            size = 0
            for i in range(len(ends) - 1):
                text = buf[offs[i] : offs[i + 1]].tobytes()
                key = keys[i].as_py()
                for j in range(ends[i], ends[i + 1]):
                    p = int(place[j])
                    if not hot[j]:
                        out.append((int(gram[j]) % buckets, int(gram[j]), key, p, p - int(lo[j]), text[lo[j] : hi[j] + length]))
                    else:
                        for k in range((p - int(hi[j])) // SLICE, (p - int(lo[j])) // SLICE + 1):
                            first, last = max(int(lo[j]), p - SLICE * k - SLICE + 1), min(int(hi[j]), p - SLICE * k)
                            same = hashlib.blake2b(text[p - SLICE * k : p - SLICE * k - SLICE + 1 + length] + bytes([k]), digest_size=8).digest()
                            out.append((-1, int.from_bytes(same, "little", signed=True), key, p, p - first, text[first : last + length]))
                    size += 800
                    if size > 4 << 20:
                        yield _batch(out)
                        out, size = [], 0
            if out:
                yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "gram", "key", "place", "left", "bytes"])

    return rows.select("key", "text", "found").mapInArrow(run, "bucket long, gram long, key string, place long, left int, bytes binary")


def _symbols(rows: np.ndarray) -> np.ndarray:
    """Ranks (from 1) of the 16-byte symbols of byte rows; the rows' width is a multiple of 16."""
    n, width = rows.shape
    words = rows.reshape(-1).view(">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((words[:, 1], words[:, 0]))
    w = words[order]
    rank = np.empty(len(w), np.int64)
    rank[order] = np.append(0, np.cumsum((w[1:] != w[:-1]).any(1)))
    return rank.reshape(n, width // 16) + 1


def _merged(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, first by group, and the bytes that each has in common with the one above (-1: another group)."""
    symbols = np.column_stack([group + 1, _symbols(rows)])
    order, common = bwt.sorted_strings(symbols)
    m = rows.shape[1]
    out = np.minimum((common - 1) * 16, m)
    # within the symbol where they part
    part = np.flatnonzero((common > 0) & (out < m))
    part = part[part > 0]
    cols = out[part][:, None] + np.arange(16)
    same = rows[order[part]][np.arange(len(part))[:, None], cols] == rows[order[part - 1]][np.arange(len(part))[:, None], cols]
    out[part] += np.minimum.accumulate(same, axis=1).sum(1)
    out[0] = -1
    return order, out


def repeated(gram: np.ndarray, left: np.ndarray, contexts: list[bytes], copies: np.ndarray, length: int) -> np.ndarray:
    """For each context and each a: whether the string that begins a bytes before the anchor occurs in another context."""
    n = len(contexts)
    width = length - GRAM
    size = np.array([len(c) for c in contexts])
    flat = np.frombuffer(b"".join(contexts) + bytes(length), np.uint8)
    first = np.cumsum(size) - size
    right_n = size - left
    cols = np.arange(-(-length // 16) * 16)
    right = np.where(cols < np.minimum(right_n, length)[:, None], flat[np.minimum((first + left)[:, None] + cols, len(flat) - 1)], 0).astype(np.uint8)
    cols = np.arange(-(-width // 16) * 16)
    back = np.where(cols < left[:, None], flat[np.maximum((first + left)[:, None] - 1 - cols, 0)], 0).astype(np.uint8)
    _, group = np.unique(gram, return_inverse=True)
    order_r, lcp_r = _merged(right, group)
    order_l, lcp_l = _merged(back, group)
    out = np.zeros((n, width + 1), bool)
    low = np.maximum(0, length - right_n)
    id_r, id_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(width + 1):
        on = np.flatnonzero((low <= a) & (a <= left))
        if not len(on):
            continue
        # intervals of length - a common bytes to the right and of a to the left
        id_r[order_r] = np.cumsum(lcp_r < length - a)
        id_l[order_l] = np.cumsum(lcp_l < a)
        both = id_r[on] * (n + 1) + id_l[on]
        order = np.argsort(both, kind="stable")
        both = both[order]
        new = np.append(True, both[1:] != both[:-1])
        which = np.cumsum(new) - 1
        total = np.bincount(which, copies[on][order])
        out[on[order], a] = total[which] > 1
    return out


def _found(contexts: DataFrame, length: int) -> DataFrame:
    """(key, from, to): repeated strings start at from .. to."""

    def bucket(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        gram, place, left = (table.column(c).to_numpy() for c in ("gram", "place", "left"))
        # equal contexts of equal grams are merged once
        index: dict[tuple[int, int, bytes], int] = {}
        which = np.array([index.setdefault(k, len(index)) for k in zip(gram.tolist(), left.tolist(), table.column("bytes").to_pylist(), strict=True)])
        keys = list(index)
        hit = repeated(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), [k[2] for k in keys], np.bincount(which), length)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        per = np.searchsorted(row, np.arange(len(keys) + 1))
        take = t.ranges(per[which], per[which + 1] - per[which])
        one = np.repeat(np.arange(len(which)), per[which + 1] - per[which])
        return pa.table({"key": table.column("key").take(pa.array(one)), "from": pa.array(place[one] - (b[take] - 1)), "to": pa.array(place[one] - a[take])})

    return contexts.groupBy("bucket").applyInArrow(bucket, "key string, `from` long, `to` long")


def _found_hot(slices: DataFrame, buckets: int, length: int, hot: int) -> DataFrame:
    """The same of hot grams' slices."""
    often = stored(slices.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "often")
    again = slices.join(often, "gram")
    out = _found(again.where(F.col("n") <= hot).select(F.pmod("gram", F.lit(buckets)).alias("bucket"), "gram", "key", "place", "left", "bytes"), length)
    each = again.where(F.col("n") > hot).select("key", (F.col("place") - F.col("left")).alias("first"), "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("k"))
    each = each.select("key", (F.col("first") + F.col("k")).alias("from"), F.sha2(F.substring(F.col("bytes"), F.col("k") + 1, F.lit(length)), 256).alias("digest"))
    twice = stored(each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "twice")
    return out.union(each.join(twice, "digest").select("key", "from", F.col("from").alias("to")))


def _spans(starts: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["from"], s["to"] + length) for s in starts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, bucket_rows: int = BUCKET) -> DataFrame:
    """(doc_id, kept, spans, n_passage_words) of every row: the bytes left, the removed runs (start, end), and how many words
    lie in passages that another row holds too."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), body.alias("text"), F.md5(body.cast("binary")).alias("key"))
    full = stored(_signatures(named.select("id", "text", "key"), length), "anchors")
    # texts that occur in several rows, and one row of each text with its anchors
    copies = full.groupBy("key").agg(F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes"), F.max("n_words").alias("n_words")).where("n > 1")
    whole = stored(copies.select("key", (F.col("n_bytes") >= length).alias("whole"), F.when(F.col("n_words") >= PASSAGE, F.col("n_words")).alias("all_words")), "whole")
    lists = F.struct("id", "gram", "place", "lo", "hi", "word_gram", "first", "last")
    one = stored(full.where((F.size("gram") > 0) | (F.size("word_gram") > 0)).groupBy("key").agg(F.min(lists).alias("r")).select("key", "r.*"), "texts")
    discard(full)
    passages = _passages(one.where(F.size("word_gram") > 0), named.select("key", "id", "text"))
    one_gram = one.select("key", "id", F.explode(F.arrays_zip("gram", "place", "lo", "hi")).alias("x")).select("key", "id", "x.*")
    often = stored(one_gram.groupBy("gram").agg(F.count("*").alias("n_gram")).where("n_gram > 1"), "often")  # stored, so the join can split a hot gram
    shared = one_gram.join(often, "gram").select("key", "id", F.struct("gram", "place", "lo", "hi", (F.col("n_gram") > hot).alias("hot")).alias("x"))
    shared = stored(shared.groupBy("key", "id").agg(F.collect_list("x").alias("found")), "shared")
    buckets = max(1, (shared.agg(F.sum(F.size("found"))).first()[0] or 0) // bucket_rows)
    body_of = named.select("key", "id", "text")

    def of(is_hot: bool) -> DataFrame:
        part = shared.withColumn("found", F.filter("found", lambda x: x["hot"] == is_hot)).where(F.size("found") > 0)
        return _contexts(body_of.join(part, ["key", "id"]), buckets, length)

    found = _found(of(False), length)
    if shared.where(F.exists("found", lambda x: x["hot"])).limit(1).count():
        slices = stored(of(True), "slices")
        found = found.union(_found_hot(slices, buckets, length, hot))
    else:
        slices = None
    found = stored(found, "found")
    starts = found.groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("starts"))
    verdict = starts.join(whole, "key", "full").join(passages, "key", "full").select("key", "starts", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("all_words", "n_passage_words", F.lit(0)).alias("n_passage_words"))
    verdict = stored(verdict, "verdict")
    for x in filter(None, (whole, one, passages, often, shared, found, slices)):
        discard(x)
    small = verdict.agg(F.count("*"), F.sum(F.coalesce(F.size("starts"), F.lit(0)))).first()
    # broadcast only what has been counted to be small
    verdict = F.broadcast(verdict) if (small[0] or 0) + (small[1] or 0) <= BROADCAST_ROWS else verdict
    rows = named.select("doc_id", "key", "text").join(verdict, "key", "left").select("doc_id", "text", "whole", "starts", F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = t.texts(batch.column("text"))
            kept, spans = [], []
            for i, (w, s) in enumerate(zip(batch.column("whole").to_pylist(), batch.column("starts").to_pylist(), strict=True)):
                raw = buf[offs[i] : offs[i + 1]].tobytes()
                runs = [(0, len(raw))] if w else _spans(s or [], length)
                edge = [0, *(x for r in runs for x in r), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in runs])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(spans, kind), batch.column("n_passage_words")], ["doc_id", "kept", "spans", "n_passage_words"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, kept binary, spans array<struct<start:bigint,end:bigint>>, n_passage_words long")
