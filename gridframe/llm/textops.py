"""Vectorised word splitting and hashing over Arrow string columns.

A batch of texts is one flat byte buffer plus offsets, so no Python object is
made per text or per word.  All hashes are fixed functions of the bytes: they
are the same in every process and at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # text handled at once; a longer text is a chunk of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words of near-duplicate detection: everything but ASCII white space
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: words of decontamination: digits, a-z (after lower-casing) and all non-ASCII bytes
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_SLOT = mix(np.arange(11, 75, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


LONG_WORD = 256  # bytes from which a word is digested whole
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word: eight bytes at a time are mixed into the state, so no sum or product of
    byte values decides, and words of up to eight bytes and one length never clash; very long words are digested."""
    size = end - start
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    eight = np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))
    h = size.astype(U64) * _SLOT[60]
    on, at, left = np.arange(len(size)), start, size
    while len(on):
        h[on] = mix(h[on] * _SLOT[61] + (eight[at] & _FIRST_BYTES[np.minimum(left, 8)]))
        more = np.flatnonzero((left > 8) & (size[on] < LONG_WORD))
        on, at, left = on[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size >= LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Words:
    """Words of some texts: hash, byte range and text of each, and the words' range of each text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray):
        self.low = low = LOWER[buf]
        is_word = word_bytes[low]
        n = len(low)
        prev, nxt = np.zeros(n, bool), np.zeros(n, bool)
        prev[1:], nxt[:-1] = is_word[:-1], is_word[1:]
        cut = offs[:-1][offs[:-1] < n]
        prev[cut] = False
        nxt[cut[cut > 0] - 1] = False
        self.start = np.flatnonzero(is_word & ~prev)
        self.end = np.flatnonzero(is_word & ~nxt) + 1
        self.hash = word_hashes(low, self.start, self.end)
        #: words of text i are first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(words: Words, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of q consecutive words, and the index of the first word; none crosses texts."""
    if len(words) < q:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = sequence_hash(words.hash, q)
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(words))
    at = np.flatnonzero(left[: len(h)] >= q)
    return h[at], at


def sequence_hash(h: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q consecutive hashes."""
    n = len(h) - q + 1
    total = np.full(max(n, 0), U64(q))
    for k in range(q):
        total += h[k : k + n] * _SLOT[k]
    return mix(total)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated aranges start[i] .. start[i] + count[i]."""
    count = np.asarray(count, np.int64)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total)
    return out + np.repeat(np.asarray(start, np.int64) - (np.cumsum(count) - count), count)


def same_bytes(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Whether each range a0 .. a1 of ``a`` holds the same bytes as b0 .. b1 of ``b``; no range is empty."""
    n = a1 - a0
    ok = n == b1 - b0
    on = np.flatnonzero(ok)
    if len(on):
        other = a[ranges(a0[on], n[on])] != b[ranges(b0[on], n[on])]
        ok[on] = ~np.logical_or.reduceat(other, np.cumsum(n[on]) - n[on])
    return ok


class Filter:
    """Fixed-size bit table that drops most values which are not among the keys, without false negatives."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.shift, self.table = U64(64 - bits), np.zeros(1 << bits, bool)
        self.table[(keys >> self.shift).astype(np.int64)] = True

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.table[(values >> self.shift).astype(np.int64)])


def hex_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
