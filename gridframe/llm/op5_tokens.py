"""Token counts of fields and sections by offset-mapped attribution.

A row's fields are joined to one whole text, which is encoded once, so tokens
are those that a model would see.  A byte-level vocabulary covers every byte, so
the lengths of the tokens' bytes give each token's place.  Sections are
intervals of the whole text: each line of each field (or the field as a whole),
and the joints between fields.  Tokens are joined to the sections they overlap
by binary search on the sections' starts.

The rule for tokens that cross a boundary: ``start`` counts a token where its
first byte is, ``most`` where most of its bytes are (the earlier on a tie), and
``split`` shares it out by bytes.  Under every rule a text's counts add up to
its number of tokens.

The vocabulary file is read on the driver and broadcast; its size is fixed.

Defined results: a null field is empty; a row whose fields are all empty gives
no section but, if there are joints, those; repeated rows are counted alike; other
columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that splits text before merges, published with this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "most", "split")
# runs of white space (Unicode's, as in the pattern) that are too long for the pattern's matcher
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


class Encoder:
    """A rank file's encoding, and the number of bytes of each id."""

    def __init__(self, file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes[list(ranks.values())] = [len(x) for x in ranks]

    def encode(self, text: str) -> list[int]:
        """Tokens of a whole text.  The pattern makes one piece of a run of white space, but for its last sign if more
        text follows; very long runs are cut out as such pieces here."""
        out, at = [], 0
        for run in BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : run.start()])
            out += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def ends(self, text: str) -> np.ndarray:
        """Where each token of the text ends, in bytes."""
        return np.cumsum(self.bytes[np.array(self.encode(text), np.int64)])


@lru_cache(maxsize=1)
def encoder_of(file: bytes) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(file)


def attribute(ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens counted for each section that begins at ``starts`` (the first at 0), and the crossing tokens that begin in it."""
    n = len(starts)
    begin = np.append(0, ends[:-1]) if len(ends) else ends
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, ends, "left") - 1
    crossing = np.flatnonzero(last > first)
    count = np.bincount(first, minlength=n).astype(float)
    if rule != "start":
        for k in crossing.tolist():
            inside = np.arange(first[k], last[k] + 1)
            edge = np.clip(np.append(starts[inside], ends[k]), begin[k], ends[k])
            share = np.diff(edge) / (ends[k] - begin[k])
            count[first[k]] -= 1
            if rule == "split":
                count[inside] += share
            else:
                count[inside[int(np.argmax(share))]] += 1
    return count, np.bincount(first[crossing], minlength=n)


def count_tokens(rows: DataFrame, *, row_id: str = "doc_id", fields: Sequence[str] = ("text",), joint: str = "\n", by_line: bool = True, rule: str = "start", tokenizer: str = TOKENIZER) -> DataFrame:
    """(row_id, field, section, start, end, n_tokens, n_crossing): one row for each section of each row.

    ``start`` and ``end`` count the code points of the whole text; ``field`` is null for a joint.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(tokenizer, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())
    names, glue = list(fields), joint.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            ids = batch.column("_id")
            out: list[list] = [[] for _ in range(7)]
            for i, values in enumerate(zip(*(batch.column(f"_f{k}").to_pylist() for k in range(len(names))), strict=True)):
                parts = [(v or "").encode() for v in values]
                starts, labels, at = [], [], 0
                for k, part in enumerate(parts):
                    if k and glue:
                        starts.append(at)
                        labels.append((None, 0))
                        at += len(glue)
                    lines = np.flatnonzero(np.frombuffer(part, np.uint8) == 10) + 1 if by_line else np.zeros(0, np.int64)
                    lines = np.append(0, lines[lines < len(part)]) if part else lines[:0]
                    starts += (lines + at).tolist()
                    labels += [(names[k], j) for j in range(len(lines))]
                    at += len(part)
                if not starts:
                    continue
                whole = glue.join(parts)
                s = np.array(starts)
                n, crossing = attribute(encoder.ends(whole.decode()), s, rule)
                points = np.append(0, np.cumsum((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80))
                for col, x in zip(out, ([i] * len(s), [f for f, _ in labels], [j for _, j in labels], points[s], points[np.append(s[1:], at)], n, crossing), strict=True):
                    col.extend(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            which, *rest = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(which), *rest], [row_id, "field", "section", "start", "end", "n_tokens", "n_crossing"])

    picked = rows.select(F.col(row_id).alias("_id"), *(F.col(f).cast("string").alias(f"_f{k}") for k, f in enumerate(names)))
    kind = rows.schema[row_id].dataType.simpleString()
    return picked.mapInArrow(run, f"`{row_id}` {kind}, field string, section long, start long, `end` long, n_tokens double, n_crossing long")
