"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

A collection holds equally long strings of positive symbols, each followed by a
terminator (0) that is smaller than all others and than later strings' own.  The transform lists, for
all suffixes in order, the symbol before each.  Two or more transforms merge without
comparing suffixes: the interleave starts as one block of shards; each round
stably deals the entries out by their symbol, which orders the suffixes by one
symbol more.  The round in which two neighbours part tells how many symbols
they have in common (Holt and McMillan 2014; Egidi and others 2019 for the common prefixes).
"""

from __future__ import annotations

import numpy as np


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable argsort of 32-bit numbers: two radix passes of 16 bits."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    high = (values >> 16).astype(np.uint16)
    return order if not high.any() else order[np.argsort(high[order], kind="stable")]


class Transform:
    """Of one shard: the symbols before each suffix in order, and which strings the whole-string suffixes are."""

    def __init__(self, strings: np.ndarray):
        n, m = strings.shape
        text = np.zeros((n, m + 1), np.int64)
        text[:, :m] = strings
        rank = np.unique(text, return_inverse=True)[1].reshape(n, m + 1)
        step, order = 1, None
        while order is None or step <= m:
            after = np.zeros_like(rank)
            after[:, :-step] = rank[:, step:] + 1
            key = (rank * (rank.max() + 2) + after).ravel()
            order = np.argsort(key, kind="stable")
            new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
            rank = np.empty(n * (m + 1), np.int64)
            rank[order] = new
            rank = rank.reshape(n, m + 1)
            step *= 2
        before = np.zeros((n, m + 1), np.int64)
        before[:, 1:] = text[:, :m]
        self.symbols = before.ravel()[order].astype(np.uint32)
        #: the string whose beginning an entry is, or -1
        self.string = np.where(order % (m + 1) == 0, order // (m + 1), -1)
        self.length = m


def merge(shards: list[Transform]) -> tuple[np.ndarray, np.ndarray]:
    """The interleave (shard of each entry), and for each entry the symbols that it and the entry above have in common,
    -1 if all of them."""
    length = shards[0].length
    sizes = [len(s.symbols) for s in shards]
    # suffixes of just a terminator come first, in the order of the strings
    ends = np.repeat(np.arange(len(shards), dtype=np.uint8), [n // (length + 1) for n in sizes])
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    parted = np.full(len(z), -1, np.int32)  # the round in which an entry and the one above were told apart
    parted[0] = 0
    symbols = np.empty(len(z), np.uint32)
    for h in range(length + 1):
        for k, s in enumerate(shards):
            symbols[z == k] = s.symbols
        block = np.cumsum(parted >= 0)
        order = stable_order(symbols)
        c, b = symbols[order], block[order]
        fresh = np.append(True, (c[1:] != c[:-1]) | (b[1:] != b[:-1]))
        fresh[: len(ends)] = True
        new = (parted < 0) & fresh
        parted[new] = h
        before, z = z, z[order]
        z[: len(ends)] = ends
        if not new.any() and h and np.array_equal(before, z):
            break
    return z, parted


def sorted_strings(strings: np.ndarray, shards: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long strings, and how many symbols each has in common with the one above in it, by merged transforms."""
    n = len(strings)
    cuts = np.linspace(0, n, min(shards, n) + 1).astype(int)
    parts = [Transform(strings[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    z, parted = merge(parts)
    string = np.empty(len(z), np.int64)
    for k, p in enumerate(parts):
        string[z == k] = np.where(p.string >= 0, p.string + cuts[k], -1)
    # never parted: equal to the end of the strings
    common = np.where(parted < 0, strings.shape[1], parted).astype(np.int64)
    # the least over the entries between two whole strings
    at = np.flatnonzero(string >= 0)
    least = np.minimum.reduceat(common[: at[-1] + 1], np.append(0, at[:-1] + 1)) if len(at) else common
    return string[at], least
