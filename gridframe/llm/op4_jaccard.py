"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles.  Two link when their sets'
Jaccard similarity is at least 3/4.  All shingles have one global order, from
rare to frequent by a fixed-size frequency sketch of the whole corpus.  Under
any order, two linked sets share at least L shingles of their L-prefixes (the
first |x| - overlap + L ones).  Each document chooses the L of the pairs in
which it is the longer: from its own tokens' estimated posting lengths, a longer
prefix costs more probes but leaves fewer candidates to verify.

Links are found without listing the pairs of a group.  Documents of one set
are one node.  First every node is verified against a central set of the groups that
its prefix shingles form; this joins groups of copies.  Then all remaining pairs are
compared, but only across components: components are what the links define, so no link
between them can be missed.

Shingles that few sets hold give pairs, which are counted until L are shared.  Where
many sets meet, a task compares them by parity bitmaps of their shingles: the bits in
which two bitmaps differ never outnumber the shingles in which the sets differ, so
a pair with too many is no link and never becomes a row.

Defined results: words are split at ASCII white space after lower-casing A-Z;
fewer words than a shingle count as one shingle; without words (or with a null
text) a document links with nothing; repeated rows and equal sets belong
together; ids may repeat or be null (the component is the least id that isn't);
other columns are not read.  Shingles are compared by 64-bit hashes and whole
sets by 128 bits.  The frequency sketch and the filter of sets to verify are the only
broadcasts; their cells follow the input up to 2 ** MOST_BITS, beyond which they only get less sharp.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textops as t
from .components import components
from .shared import discard, lean, partitions, stored

SHINGLE = 5
MOST_MATCHES = 4  # the largest L
MOST_BITS = 24  # cells of the sketch, as a power of two
BLOCK = 1 << 18  # counters in a row of the sketch
HOT = 4_000  # documents of a shingle that one task compares at once
LIGHT = 8  # sets of a shingle whose pairs are counted; of more, bitmaps are compared
LEAD = 8  # earlier shared shingles of a set by which a pair is known to be another shingle's
WIDTHS = (512, 2048, 8192, 32768)  # bits of a set's bitmap; a set has at most half as many shingles, if it isn't of the last kind
GROUP = 256  # partners that one set is verified with in a task
SPREAD = 256  # parts that the entries of a hot shingle are dealt to
PAIRS = 1 << 18  # pairs that a task compares at once
ENTRIES = 1 << 20  # prefix entries that a task packs at once, and that a bucket of shingles holds on average at most


def cells(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sketch's cell of each shingle; the length of ``counts`` is a power of two."""
    return (h >> np.uint64(65 - int(len(counts)).bit_length())).astype(np.int64)


def width_class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(WIDTHS[:-1]) // 2, n, "left")


class Sets:
    """Distinct shingles of each text, in an order given by a value of each shingle."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, rank: np.ndarray | None):
        w = t.Words(buf, offs, t.NON_SPACE)
        n = np.diff(w.first)
        h, at = t.shingles(w, SHINGLE)
        doc = np.searchsorted(w.first, at, "right") - 1
        few = np.flatnonzero((n > 0) & (n < SHINGLE))
        if len(few):
            whole = np.zeros(len(few), np.uint64)
            for q in range(1, SHINGLE):
                on = np.flatnonzero(n[few] == q)
                if len(on):
                    whole[on] = t.sequence_hash(w.hash, q)[w.first[few[on]]]
            h, doc = np.concatenate([h, whole]), np.concatenate([doc, few])
        key = doc.astype(np.int64) << 32
        if rank is not None:
            key |= rank[cells(h, rank)]
        order = np.lexsort((h, key))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hash = h[new]
        self.first = np.searchsorted(doc[new], np.arange(len(n) + 1))
        self.size = np.diff(self.first)
        self.key1, self.key2 = self._digest(1), self._digest(2)

    def bitmaps(self) -> pa.Array:
        """Of each set, which hash cells hold an odd number of its shingles."""
        width = np.array(WIDTHS)[width_class(self.size)]
        first = np.append(0, np.cumsum(width))
        doc = np.repeat(np.arange(len(self.size)), self.size)
        odd = np.bincount(first[doc] + (self.hash & (width[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=first[-1]) & 1
        return pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer((first // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd.astype(np.uint8), bitorder="little"))])

    def _digest(self, k: int) -> np.ndarray:
        """64 bits of each whole set, whatever its order."""
        total = np.append(np.uint64(0), np.cumsum(t.mix(self.hash * t._SLOT[40 + k] + np.uint64(k))))
        return t.mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(np.uint64) * t._SLOT[50 + k]).view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], column: str, rank: np.ndarray | None) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for batch in batches:
        buf, offs = t.texts(batch.column(column))
        for a, b in t.chunks(offs):
            yield batch.slice(a, b - a), Sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], rank)


def sketch(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles of all texts counted in a power of two of cells, about one for 128 bytes: a row set of each partition, summed."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    n = 1 << min(MOST_BITS, max(18, (size // 128).bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.uint32)
        for batch in batches:
            buf, offs = t.texts(batch.column(0))
            for a, b in t.chunks(offs):
                h, _ = t.shingles(t.Words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], t.NON_SPACE), SHINGLE)
                at = np.sort(cells(h, total))
                new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
                total[at[new]] += np.diff(np.append(new, len(at))).astype(np.uint32)
        rows = total.reshape(-1, BLOCK)
        for k in np.flatnonzero(rows.any(1)).tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "counts": pa.array([zlib.compress(rows[k].tobytes(), 1)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        total = np.minimum(total, (1 << 16) - 1).astype(np.uint16)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(count), "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    out = np.zeros(n, np.uint16).reshape(-1, BLOCK)
    for r in rows:
        out[r.block] = np.frombuffer(zlib.decompress(r.counts), np.uint16)
    return out.ravel()


def overlap_longer(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set with a linked one that is no longer: ceil(3/4 n)."""
    return -(-3 * n // 4)


def overlap_shorter(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set with a linked one that is no shorter: ceil(6/7 n)."""
    return -(-6 * n // 7)


def choose_matches(n: int, posting: np.ndarray) -> int:
    """L of a set whose ordered shingles have these estimated posting lengths (beyond its own entry)."""
    need = int(overlap_longer(np.array(n)))
    cost = np.cumsum(posting)
    if not cost[-1]:
        return 1
    best, choice = np.inf, 1
    for m in range(1, min(MOST_MATCHES, need) + 1):
        probes = float(cost[min(n, n - need + m) - 1])
        price = probes + probes / m * (n / 8)
        if price < best:
            best, choice = price, m
    return choice


def signatures(docs: DataFrame, doc_id: str, text: str, counts: np.ndarray) -> DataFrame:
    """Per row: id, set size, digests, L, the share of shingles that other sets are estimated to hold, and only at a set's
    first row in each partition its bitmap, its prefix, and the places in that of shingles that very many sets seem to hold."""
    mean = float(counts.mean())
    noise = mean + 4 * mean**0.5 + 1
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        seen: set[tuple[int, int]] = set()
        for part, s in _batches(batches, "text", rank):
            posting = np.maximum(0, rank[cells(s.hash, rank)] - noise)
            has = np.append(0, np.cumsum(posting > 0))
            matches = np.ones(len(s.size), np.int64)
            for i in np.flatnonzero((has[s.first[1:]] > has[s.first[:-1]]) & (s.size > 0)):
                matches[i] = choose_matches(int(s.size[i]), posting[s.first[i] : s.first[i + 1]])
            length = np.minimum(s.size, np.maximum(s.size - overlap_longer(s.size) + matches, s.size - overlap_shorter(s.size) + MOST_MATCHES))
            twin = np.zeros(len(s.size), bool)
            for i, k in enumerate(zip(s.key1.tolist(), s.key2.tolist(), strict=True)):
                twin[i] = k in seen
                seen.add(k)
            length[twin] = 0
            common = (100 * (has[s.first[1:]] - has[s.first[:-1]])) // np.maximum(s.size, 1)
            values = s.hash[t.ranges(s.first[:-1], length)].view(np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(values))
            place = t.ranges(np.zeros(len(length), np.int64), length)
            is_hot = rank[cells(values.view(np.uint64), rank)] > 5 * HOT + noise
            ends = np.append(0, np.cumsum(is_hot))[np.append(0, np.cumsum(length))]
            hot = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[is_hot], pa.int32()))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n": pa.array(s.size), "k1": pa.array(s.key1), "k2": pa.array(s.key2), "m": pa.array(matches, pa.int32()), "common": pa.array(common, pa.int32()), "bits": pc.if_else(pa.array(twin | (s.size == 0)), None, s.bitmaps()), "prefix": prefix, "hot": hot})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n long, k1 long, k2 long, m int, common int, bits binary, prefix array<long>, hot array<int>")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of rows sorted by ``key`` in pieces that split no key, with the starts of the keys."""
    rest: dict[str, np.ndarray] | None = None
    starts = lambda k: np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    for batch in batches:
        new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        rest = new if rest is None else {n: np.concatenate([rest[n], new[n]]) for n in new}
        k = rest[key]
        cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if cut:
            piece, rest = {n: x[:cut] for n, x in rest.items()}, {n: x[cut:] for n, x in rest.items()}
            yield piece, starts(piece[key])
    if rest is not None and len(rest[key]):
        yield rest, starts(rest[key])


#: an entry of a set's prefix: its shingle, its set's digest, size, L and share of common shingles, its place, and whether its shingle is dealt out
ENTRY = {"token": np.uint64, "k1": np.int64, "n": np.int32, "m": np.int8, "common": np.int8, "pos": np.int32, "hot": np.bool_}


def _planes(x: np.ndarray) -> bytes:
    """A column byte by byte, all first bytes first, compressed: the upper bytes of small numbers cost next to nothing."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def _unplaned(data: bytes, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def _entries(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    prefix, hot = batch.column("prefix"), batch.column("hot")
    size, marks = (c.value_lengths().to_numpy() for c in (prefix, hot))
    first = np.append(0, np.cumsum(size))
    is_hot = np.zeros(first[-1], bool)
    is_hot[np.repeat(first[:-1], marks) + hot.flatten().to_numpy()] = True
    row = np.repeat(np.arange(len(size)), size)
    x = {"token": prefix.flatten().to_numpy(), "pos": np.arange(first[-1]) - first[row], "hot": is_hot}
    x |= {c: batch.column(c).to_numpy()[row] for c in ("k1", "n", "m", "common")}
    return {c: x[c].view(d) if c == "token" else x[c].astype(d) for c, d in ENTRY.items()}


def _packed(x: dict[str, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries by bucket of shingles (shingles that are dealt out: of shingle and part), sorted, as differences of their hashes."""
    key = np.where(x["hot"], t.mix(x["token"] + t._SLOT[8] * (x["k1"] % SPREAD).astype(np.uint64)), x["token"])
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.lexsort((x["token"], bucket))
    bucket = bucket[order]
    x = {c: v[order] for c, v in x.items()}
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    step = x["token"].copy()
    step[1:] -= x["token"][:-1]
    step[edge] = x["token"][edge]
    x["token"] = step
    edge = np.append(edge, len(bucket))
    for lo in range(0, len(edge) - 1, 64):
        ends = list(zip(edge[lo : lo + 64].tolist(), edge[lo + 1 : lo + 65].tolist(), strict=False))
        data = {c: pa.array([_planes(x[c][a:b]) for a, b in ends], pa.binary()) for c in ENTRY}
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[edge[lo : lo + len(ends)]]), "size": pa.array([b - a for a, b in ends], pa.int32())} | data)


def _met(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of entries, those whose shingle another set has or which are dealt out, with their shingle's pivot."""
    if not len(x["token"]):
        return
    order = np.lexsort((x["k1"], x["token"]))
    x = {c: v[order] for c, v in x.items()}
    token, k1 = x["token"], x["k1"]
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    twin = np.append(False, (token[1:] == token[:-1]) & (k1[1:] == k1[:-1]))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(token))))
    keep = ~twin & ((np.bincount(group, ~twin)[group] > 1) | x["hot"])
    central = np.lexsort((k1 * np.int64(t._SLOT[7].astype(np.int64)), x["common"], group))[np.append(start[1:], len(k1)) - 1][group]
    for on in np.array_split(np.flatnonzero(keep), max(1, int(keep.sum()) >> 16)):
        if len(on):
            out = {"token": token[on].view(np.int64), "k1": k1[on], "n": x["n"][on], "m": x["m"][on].astype(np.int32), "pos": x["pos"][on], "py": k1[central[on]], "pn": x["n"][central[on]]}
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in out.items()})


def _shared_postings(signature: DataFrame) -> DataFrame:
    """Entries of the shingles that at least two sets have in their prefixes, with the shingle's pivot (``py``, of size ``pn``).

    The pivot is the set with the greatest share of shingles that others hold, so a text rather than its altered copies;
    of a shingle that is dealt out, each part and piece has its own.  Entries are shuffled in packed form: most belong to
    shingles of one set and go no further.
    """
    n = partitions(signature.sparkSession)
    # a prefix has about a quarter of its set's shingles; n times as many buckets as needed, so partitions hold as many each
    buckets = n * max(1, -(-(signature.agg(F.sum("n")).first()[0] or 0) // (4 * ENTRIES * n)))
    kinds = ", ".join(f"{c} binary" for c in ENTRY)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(_entries(batch))
            size += len(held[-1]["token"])
            if size > ENTRIES:
                yield from _packed({c: np.concatenate([h[c] for h in held]) for c in ENTRY}, buckets)
                held, size = [], 0
        if size:
            yield from _packed({c: np.concatenate([h[c] for h in held]) for c in ENTRY}, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most, at = [], 0, ENTRIES, None
        dealt = np.zeros(0, np.uint64)

        def joined() -> dict[str, np.ndarray]:
            x = {c: np.concatenate([h[c] for h in held]) for c in ENTRY}
            x["hot"] |= np.isin(x["token"], dealt)
            return x

        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if at != r["bucket"]:
                    if size:
                        yield from _met(joined())
                    held, size, most, at, dealt = [], 0, ENTRIES, r["bucket"], np.zeros(0, np.uint64)
                x = {c: _unplaned(r[c], r["size"], d) for c, d in ENTRY.items()}
                x["token"] = np.cumsum(x["token"], dtype=np.uint64)
                held.append(x)
                size += r["size"]
                if size > most:
                    # entries of shingles that many sets hold are given at once; all others of the bucket wait for its end
                    x = joined()
                    token, count = np.unique(x["token"], return_counts=True)
                    dealt = np.union1d(dealt, token[count > HOT])
                    x["hot"] |= np.isin(x["token"], dealt)
                    yield from _met({c: v[x["hot"]] for c, v in x.items()})
                    held = [{c: v[~x["hot"]] for c, v in x.items()}]
                    size = len(held[0]["token"])
                    most = size + ENTRIES
        if size:
            yield from _met(joined())

    rows = signature.where("n > 0").select("k1", "n", "m", "common", "prefix", "hot").mapInArrow(lean(pack), f"bucket int, size int, {kinds}")
    return rows.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "token long, k1 long, n int, m int, pos int, py long, pn int")


def _mixed(known: DataFrame) -> DataFrame:
    """Entries of shingles that sets of several components hold, with the number of those sets, in a stored table."""
    several = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n_token")).where("lo <> hi")
    several = stored(several.select("token", "n_token"), "several")  # so the join can split hot shingles
    mixed = stored(known.join(several, "token"), "mixed")
    discard(several)
    return mixed


def _meetings(x: dict[str, np.ndarray], start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (longer or equal, shorter) of entries of one cell and different components that prefixes and sizes allow.

    Entries are sorted by cell, component and set.  A cell that holds two blocks of a hot shingle only pairs across these.
    """
    cell, comp, k, n, m, pos, block = (x[c] for c in ("cell", "comp", "k1", "n", "m", "pos", "block"))
    n, m, pos = n.astype(np.int64), m.astype(np.int64), pos.astype(np.int64)
    lead = [np.maximum(1, pos + 1 - (n - o(n))) for o in (overlap_longer, overlap_shorter)]
    end = np.append(start[1:], len(comp))
    two = np.minimum.reduceat(block, start) != np.maximum.reduceat(block, start)
    # entries of one component are neighbours: each entry meets those after its component's last
    last = np.append(np.flatnonzero((comp[1:] != comp[:-1]) | (cell[1:] != cell[:-1])) + 1, len(comp))
    run_of = np.searchsorted(last, np.arange(len(comp)), "right")
    cell_of = np.repeat(np.arange(len(start)), end - start)
    count = end[cell_of] - last[run_of]
    total = np.append(0, np.cumsum(count))
    lo = 0
    while lo < len(comp):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        j = t.ranges(last[run_of[lo:hi]], count[lo:hi])
        swap = (n[i] < n[j]) | ((n[i] == n[j]) & (k[i] < k[j]))
        big, small = np.where(swap, j, i), np.where(swap, i, j)
        ok = (4 * n[small] >= 3 * n[big]) & (lead[0][big] <= m[big]) & (lead[1][small] <= m[big]) & ((block[big] != block[small]) | ~two[cell_of[big]])
        if ok.any():
            yield big[ok], small[ok]
        lo = hi


def _light(mixed: DataFrame) -> DataFrame:
    """Pairs (x no shorter than y) of different components that share at least L prefix shingles, of those few sets hold."""
    rows = mixed.where(F.col("n_token") <= LIGHT).withColumns({"cell": F.col("token"), "block": F.lit(0)})
    rows = rows.select("cell", "comp", "k1", "n", "m", "pos", "block").repartition(partitions(mixed.sparkSession), "cell").sortWithinPartitions("cell", "comp", "k1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, start in _groups(batches, "cell"):
            for big, small in _meetings(x, start):
                yield pa.RecordBatch.from_pydict({"x": pa.array(x["k1"][big]), "y": pa.array(x["k1"][small]), "m": pa.array(x["m"][big]), "nx": pa.array(x["n"][big]), "ny": pa.array(x["n"][small]), "px": pa.array(x["pos"][big]), "py": pa.array(x["pos"][small])})

    pairs = rows.mapInArrow(lean(run), "x long, y long, m int, nx int, ny int, px int, py int")
    # a pair that also shares a shingle of many sets is judged there, whatever its count is here
    pairs = pairs.groupBy("x", "y").agg(F.count("*").alias("got"), *(F.max(c).alias(c) for c in ("m", "nx", "ny", "px", "py"))).where("got >= m")
    # what may still be shared: nothing up to the earlier prefix's end but what was found, nothing before the last found
    rest_x, rest_y = F.expr("nx - least(nx, nx - ceil(3 * nx / 4) + m)"), F.expr("ny - least(ny, ny - ceil(6 * ny / 7) + m)")
    most = F.col("got") + F.least(F.greatest(rest_x, rest_y), F.expr("nx - px - 1"), F.expr("ny - py - 1"))
    return pairs.where(7 * most >= 3 * (F.col("nx") + F.col("ny"))).select("x", "y")


class Bitmaps:
    """Bitmaps of some entries by width, each also folded to the next lesser width."""

    def __init__(self, bits: np.ndarray, n: np.ndarray):
        self.known = np.array([b is not None for b in bits])
        self.kind = width_class(n)
        self.row = np.zeros(len(n), np.int64)
        self.whole, self.folded = {}, {}
        for c in np.unique(self.kind).tolist():
            on = np.flatnonzero(self.kind == c)
            self.row[on] = np.arange(len(on))
            self.whole[c] = np.frombuffer(b"".join(b or bytes(WIDTHS[c] // 8) for b in bits[on]), np.uint64).reshape(len(on), -1)
            if c:
                self.folded[c] = np.bitwise_xor.reduce(self.whole[c].reshape(len(on), WIDTHS[c] // WIDTHS[c - 1], -1), axis=1)

    def differences(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A lower bound of the shingles that only one set of each pair holds; sizes differ by at most a third."""
        out = np.zeros(len(i), np.int64)
        for a in np.unique(self.kind[i]).tolist():
            for b in {a - 1, a, a + 1} & set(self.whole):
                on = np.flatnonzero((self.kind[i] == a) & (self.kind[j] == b))
                one, two = (self.whole[a], self.whole[b]) if a == b else (self.folded[a], self.whole[b]) if a > b else (self.whole[a], self.folded[b])
                step = max(1, (4 << 20) // (one.shape[1] * 8))
                for k in range(0, len(on), step):
                    part = on[k : k + step]
                    out[part] = np.bitwise_count(one[self.row[i[part]]] ^ two[self.row[j[part]]]).sum(1)
        out[~(self.known[i] & self.known[j])] = 0
        return out


def _dense(mixed: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs (x no shorter than y) of different components that share a prefix shingle of more than LIGHT sets and that
    bitmaps don't rule out."""
    many = mixed.where(F.col("n_token") > LIGHT)
    held = F.sort_array(F.collect_list(F.struct("pos", "token", "n_token")))
    sets = many.groupBy("k1").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("comp").alias("comp"), held.alias("held")).join(bits, "k1")
    rows = sets.select("k1", "n", "m", "comp", "bits", F.transform(F.slice("held", 1, LEAD), lambda h: h["token"]).alias("heads"), F.posexplode("held").alias("at", "h"))
    # an entry carries no more than its set's earlier shingles
    rows = rows.select("k1", "n", "m", "comp", "bits", F.slice("heads", F.lit(1), F.least("at", F.lit(LEAD))).alias("lead"), "h.pos", "h.token", "h.n_token")
    # very frequent shingles are compared block by block, each pair of blocks in one group
    blocks = F.ceil(F.col("n_token") / HOT).cast("int")
    mine = F.pmod(F.xxhash64("k1"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(j, mine) * blocks + F.greatest(j, mine))
    rows = rows.withColumn("block", mine).withColumn("pair", F.explode(pair)).withColumn("cell", F.when(blocks == 1, F.col("token")).otherwise(F.xxhash64("token", "pair")))
    rows = rows.select("cell", "comp", "k1", "n", "m", "pos", "block", "lead", "bits").repartition(partitions(mixed.sparkSession), "cell").sortWithinPartitions("cell", "comp", "k1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, start in _groups(batches, "cell"):
            n, k = x["n"].astype(np.int64), x["k1"]
            maps = Bitmaps(x["bits"], n)
            lead = np.zeros((len(n), LEAD), np.int64)
            used = np.array([len(v) for v in x["lead"]])
            lead[np.arange(LEAD) < used[:, None]] = np.concatenate(x["lead"])
            for big, small in _meetings(x, start):
                ok = 7 * maps.differences(big, small) <= n[big] + n[small]
                big, small = big[ok], small[ok]
                # a pair that shares an earlier shingle among the LEAD first ones is given there
                mine = np.ones(len(big), bool)
                for a in range(0, len(big), 1 << 14):
                    i, j = big[a : a + (1 << 14)], small[a : a + (1 << 14)]
                    known = (np.arange(LEAD) < used[i, None])[:, :, None] & (np.arange(LEAD) < used[j, None])[:, None, :]
                    mine[a : a + (1 << 14)] = ~((lead[i][:, :, None] == lead[j][:, None, :]) & known).any((1, 2))
                if mine.any():
                    yield pa.RecordBatch.from_pydict({"x": pa.array(k[big[mine]]), "y": pa.array(k[small[mine]])})

    return rows.mapInArrow(lean(run), "x long, y long")


def verified(docs: DataFrame, pairs: DataFrame, text: str) -> DataFrame:
    """Of the pairs (x, y) of first digests, the links (a, b) of whole digests; each set is read from its whole text."""
    spark = docs.sparkSession
    size = pairs.count()
    bits = min(MOST_BITS + 3, max(16, (256 * size).bit_length()))
    low = (1 << bits) - 1
    need = pairs.select(F.explode(F.array("x", "y")).alias("k")).select(F.col("k").bitwiseAND(low).cast("int").alias("c")).distinct()
    table = np.zeros(1 << bits, bool)
    for part in need.select("c").toArrow().column("c").chunks:
        table[part.to_numpy()] = True
    needed = spark.sparkContext.broadcast(np.packbits(table))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.unpackbits(needed.value).astype(bool), set()
        for _, s in _batches(batches, "text", None):
            on = np.flatnonzero(table[s.key1 & low] & (s.size > 0))
            on = np.array([i for i in on.tolist() if not ((k := (int(s.key1[i]), int(s.key2[i]))) in seen or seen.add(k))], np.int64)
            if len(on):
                yield pa.RecordBatch.from_pydict({"k1": pa.array(s.key1[on]), "k2": pa.array(s.key2[on]), "set": pa.array([s.hash[s.first[i] : s.first[i + 1]].tobytes() for i in on], pa.binary())})

    # each y is sent once to every group of up to GROUP of its partners, and each x once for each partner
    pairs = pairs.join(pairs.groupBy("y").agg(F.ceil(F.count("*") / GROUP).alias("parts")), "y").withColumn("part", F.pmod(F.xxhash64("x"), "parts"))
    roles = pairs.select(F.col("x").alias("k1"), F.xxhash64("y", "part").alias("team"), "y", F.lit(1).alias("turn"))
    roles = roles.union(pairs.select(F.col("y").alias("k1"), F.xxhash64("y", "part"), "y", F.lit(0)).distinct())
    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(sets), "k1 long, k2 long, set binary")
    teams = found.join(roles.hint("shuffle_merge"), "k1").select("team", "turn", "y", "k1", "k2", "set").repartition(partitions(spark), "team").sortWithinPartitions("team", "y", "turn")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, heads = None, {}  # sets whose first digest is y: one, unless first digests clash
        for batch in batches:
            out = []
            team, turn, ys, k1, k2 = (batch.column(c).to_pylist() for c in ("team", "turn", "y", "k1", "k2"))
            for r, cell in enumerate(batch.column("set")):
                if y != (team[r], ys[r]):
                    y, heads = (team[r], ys[r]), {}
                p = np.frombuffer(cell.as_buffer(), np.uint64)
                if turn[r] == 0:
                    heads[k2[r]] = p
                else:
                    for two, q in heads.items():
                        both = len(np.intersect1d(p, q, assume_unique=True)) if 4 * min(len(p), len(q)) >= 3 * max(len(p), len(q)) else 0
                        if 100 * both >= 75 * (len(p) + len(q) - both):
                            out.append((k1[r], k2[r], ys[r], two))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["x", "x2", "y", "y2"])

    links = teams.mapInArrow(lean(check), "x long, x2 long, y long, y2 long")
    node = lambda p, q: F.concat(F.lpad(F.hex(p), 16, "0"), F.lpad(F.hex(q), 16, "0"))
    return stored(links.select(node("x", "x2").alias("a"), node("y", "y2").alias("b")).distinct(), "links")


def _first_digest(node: F.Column) -> F.Column:
    """The first digest back from a node's name; conv gives the unsigned number."""
    high, low = F.conv(F.substring(node, 1, 8), 16, 10).cast("long"), F.conv(F.substring(node, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def _labelled(postings: DataFrame, comp: DataFrame) -> DataFrame:
    """Postings with their sets' components so far."""
    postings, alone = postings.drop("py", "pn"), F.xxhash64("k1")
    of = comp.select(_first_digest(F.col("node")).alias("k1"), F.xxhash64("comp").alias("comp"))
    return postings.join(of, "k1", "left").withColumn("comp", F.coalesce("comp", alone))


def _star(postings: DataFrame) -> DataFrame:
    """A pair (x, y) for each set: y is the pivot that shares most prefix shingles with x.

    Sets that share few shingles are left out, as these pairs only serve to join groups of copies early.
    """
    met = postings.where("k1 <> py and 4 * least(n, pn) >= 3 * greatest(n, pn)")
    met = met.groupBy("k1", F.col("py").alias("y")).agg(F.count("*").alias("got"), F.max("n").alias("n")).where("16 * got >= n")
    return met.groupBy("k1").agg(F.max(F.struct("got", "y")).alias("best")).select(F.col("k1").alias("x"), F.col("best.y").alias("y"))


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs that are not verified yet, in either direction."""
    done = tried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).join(done, ["a", "b"], "left_anti").select("x", "y")


def _node(k1: str, k2: str) -> Column:
    return F.concat(F.lpad(F.hex(k1), 16, "0"), F.lpad(F.hex(k2), 16, "0"))


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, node) of ``docs``; (node, least, comp) of each set; (comp, component_id)."""
    counts = sketch(docs, text)
    full = stored(signatures(docs, doc_id, text, counts), "signature")
    postings = stored(_shared_postings(full), "postings")
    signature = stored(full.select("doc_id", "n", "k1", "k2"), "signature")
    # sets whose first digests clash have no bitmap, so nothing rules them out
    one = F.when(F.min("bits") == F.max("bits"), F.min("bits"))
    bits = stored(full.where("bits is not null").join(postings.select("k1").distinct(), "k1", "left_semi").groupBy("k1").agg(one.alias("bits")), "bits")
    discard(full)
    star = stored(_star(postings), "pairs")
    near = verified(docs, star, text)
    comp = components(near)
    mixed = _mixed(_labelled(postings, comp))
    pairs = stored(_untried(_dense(mixed, bits).union(_light(mixed)).distinct(), star), "pairs")
    far = verified(docs, pairs, text)
    final = components(near.union(far))
    for x in (postings, bits, star, near, comp, mixed, pairs, far):
        discard(x)
    rows = signature.select("doc_id", "n", _node("k1", "k2").alias("node"))
    # copies of one set first, then the sets of a component: no group of rows meets in one task
    ids = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = stored(ids, "ids")
    discard(final)
    return rows, ids, stored(ids.groupBy("comp").agg(F.min("least").alias("component_id")), "least")  # a stored side lets the join split a large component


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    rows, ids, least = _grouped(docs, doc_id, text)
    of_node = ids.select("node", "comp").join(least, "comp").select("node", "component_id")
    out = rows.join(of_node, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def with_sets(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_node``, the name of each row's set: null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s in _batches(batches, text, None):
            none = s.size == 0
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.key1, mask=none), pa.array(s.key2, mask=none)], [*part.schema.names, "_k1", "_k2"])

    schema = StructType([*docs.schema.fields, StructField("_k1", LongType()), StructField("_k2", LongType())])
    return docs.mapInArrow(lean(run), schema).withColumn("_node", _node("_k1", "_k2")).drop("_k1", "_k2")


def first_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the least id, null ids last; of rows with that id, the first by all columns.

    Rows are told apart by id and set, never by id alone.  A row without words links with nothing and stays.
    Columns have an order (no maps); ``text`` is a string.
    """
    _, ids, least = _grouped(docs, doc_id, text)
    first = stored(ids.join(least, "comp").where(F.col("least").eqNullSafe(F.col("component_id"))).select("comp", "node", "least"), "first")
    row = F.struct(*docs.columns)
    found = with_sets(docs, text)
    key = lambda node, i: F.concat(node, F.coalesce(F.concat(F.lit(":"), F.col(i).cast("string")), F.lit("")))
    # copies of a set under one id are one row before they are dealt out
    one = found.where("_node is not null").groupBy(key(F.col("_node"), doc_id).alias("_key")).agg(F.min(row).alias("_row"))
    comps = first.groupBy("comp").agg(F.min("node").alias("node"), F.max("node").alias("last"), F.min("least").alias("least"))
    kept = one.join(comps.where("node = last").select(key(F.col("node"), "least").alias("_key")), "_key", "left_semi").select("_row.*")
    # only where rows of several sets share the least id, or have none, does their content decide
    several = comps.where("node <> last").select("comp")
    if several.limit(1).count():
        tied = first.join(several, "comp").select("comp", key(F.col("node"), "least").alias("_key"))
        kept = kept.unionByName(one.join(tied, "_key").groupBy("comp").agg(F.min("_row").alias("_row")).select("_row.*"))
    return kept.unionByName(found.where("_node is null").select(*docs.columns))
