"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted, each with a cost.  Pieces are taken
longest first.  A piece goes to the open bin that it leaves least room in; if
none has room, a bin is opened whose size costs least per token that it could
still carry (the piece and what remains to be packed).  At the end every bin
shrinks to the cheapest permitted size that holds its contents.

Texts longer than the largest size are split into pieces of that size and a
rest, so no token is lost.  Rows are dealt to shards of about ``shard_rows``
rows by a hash, so a shard never grows with the input and each wastes at most
its few last bins.  The result depends on the rows alone.

Defined results: a row without tokens (null or empty text) gives one piece of
length 0 in no bin; repeated rows are packed as often as they occur; equal
lengths are taken in order of id, copy and piece; no rows give no rows; other
columns are not read, so their names may clash.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: what a sequence of each length costs: itself, attention over it, and a fixed part; 1024 is the least per token
SIZES: dict[int, float] = {n: 96 + n + n * n / 8192 for n in (512, 1024, 2048, 4096)}
SHARD_ROWS = 4096


def token_count(text: Column) -> Column:
    """Word runs and single other signs of a text, counted in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")), F.lit(0)).cast("long")


def best_fit(lengths: Sequence[int], sizes: Mapping[int, float]) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Bin and offset of each length (descending, none above the largest size), and each bin's final size."""
    left = int(sum(lengths))
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    bins: dict[int, list[int]] = {}  # room: bins, the oldest first
    used: list[int] = []
    which, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = sorted(sizes)
    for k, n in enumerate(lengths):
        i = bisect_left(rooms, n)
        if i < len(rooms):
            room = rooms[i]
            b = heapq.heappop(bins[room])
            if not bins[room]:
                del bins[room], rooms[i]
        else:
            room = min((s for s in order if s >= n), key=lambda s: (sizes[s] / min(s, left), -s))
            b = len(used)
            used.append(0)
        which[k], at[k] = b, used[b]
        used[b] += n
        left -= n
        if room > n:
            if room - n not in bins:
                bins[room - n] = []
                insort(rooms, room - n)
            heapq.heappush(bins[room - n], b)
    final = {b: min((s for s in order if s >= u), key=lambda s: (sizes[s], s)) for b, u in enumerate(used)}
    return which, at, final


def pack(docs: DataFrame, *, doc_id: str = "doc_id", length: Column | None = None, sizes: Mapping[int, float] = SIZES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (doc_id, copy, piece, start, n_tokens, bin_id, bin_size, bin_start): where each piece of each row goes."""
    length = token_count(F.col("text")) if length is None else length
    largest = max(sizes)
    # equal rows are counted before they are dealt out, so that many copies of one row still spread over the shards
    rows = docs.select(F.col(doc_id).alias("id"), length.alias("n")).groupBy("id", "n").count()
    total = rows.agg(F.sum("count")).first()[0] or 0
    shards = max(1, -(-total // shard_rows))
    rows = rows.select("id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("copy"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "copy"), F.lit(shards)))

    def shard(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("id", "ascending"), ("copy", "ascending"), ("n", "ascending")])).combine_chunks()
        n = table.column("n").to_numpy()
        pieces = np.maximum(1, -(-n // largest))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[row] - piece * largest, largest)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        which, at, final = best_fit(size[order].tolist(), sizes)
        first = int(table.column("shard")[0].as_py()) << 32
        bin_id, bin_size, start = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        bin_id[order], start[order] = which + first, at
        bin_size[order] = [final[b] for b in which.tolist()]
        none = size == 0
        return pa.table({
            "doc_id": table.column("id").take(pa.array(row)), "copy": table.column("copy").take(pa.array(row)), "piece": pa.array(piece), "start": pa.array(piece * largest), "n_tokens": pa.array(size),
            "bin_id": pa.array(bin_id, mask=none), "bin_size": pa.array(bin_size, mask=none), "bin_start": pa.array(start, mask=none),
        })

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.groupBy("shard").applyInArrow(shard, f"doc_id {kind}, copy long, piece long, start long, n_tokens long, bin_id long, bin_size long, bin_start long")
