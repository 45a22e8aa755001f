"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The base spans (email, ip, card, phone) come from fixed patterns and checks.
The model adds spans that the patterns miss (numbers without a plus, spaced or
spelled separators).  It is trained in numpy, once per process and from a fixed
seed, on generated sentences with labelled spans, so its weights never depend on
the table it is applied to.

Every kind holds a digit or an at sign.  So the characters within ``REACH`` of
one are all that can belong to a span; windows of ``WINDOW`` characters, each
overlapping the next by two thirds, cover all of these, over whole texts.
Each window is decoded by Viterbi; spans that a window's inner edge cuts are left
to the next window.  Over the whole text, spans are then taken by votes, length
and place, none overlapping another or a base span, if they pass the kind's
check.

Defined results: a null text is empty and has no spans; offsets count code
points, the end exclusive; repeated rows are scanned alike; only the text is
read, so other columns may clash.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as t
from .shared import lean

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, REACH = 96, 32, 40

# ---------------------------------------------------------------- base spans

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# starts are held to the first digit of a run: later ones in a run fail as it does, so one try each keeps this linear
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches by way of the at signs, as a run of local characters holds none."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        d = _DIGIT.sub("", m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


# ---------------------------------------------------------------- the model

VOCAB = 130  # 0: outside the text; 1 to 128: ASCII; 129: the rest
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, codes + 1, 129).astype(np.int16)


def _allowed() -> np.ndarray:
    """Inside follows only begin or inside of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Embedding, an LSTM for each direction, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 11, dim: int = 10, hidden: int = 16):
        r = np.random.default_rng(seed)
        self.h = hidden
        f = lambda *s: r.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.p = {"e": (f(VOCAB, dim) * 3).astype(np.float32), "out": f(2 * hidden, TAGS), "out_b": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p |= {f"x_{d}": f(dim, 4 * hidden), f"h_{d}": f(hidden, 4 * hidden), f"b_{d}": bias}

    def _run(self, ids: np.ndarray, d: str, keep: bool):
        """Hidden states in reading order of the direction; the steps' values too if they are kept."""
        n, (b, steps) = self.h, ids.shape
        table, w = self.p["e"] @ self.p[f"x_{d}"] + self.p[f"b_{d}"], self.p[f"h_{d}"]
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        hs, saved = np.zeros((steps, b, n), np.float32), []
        for s in range(steps):
            z = table[ids[:, s]] + h @ w
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            before, old = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[s] = h
            if keep:
                saved.append((i, f, o, g, before, tc, old))
        return hs, saved

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """Scores (step, row, tag)."""
        fwd, sf = self._run(ids, "f", keep)
        bwd, sb = self._run(ids[:, ::-1], "b", keep)
        both = np.concatenate([fwd, bwd[::-1]], axis=2)
        return both @ self.p["out"] + self.p["out_b"], (both, sf, sb)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Most likely tags (row, step) under the transitions."""
        e, _ = self.emissions(ids)
        move = np.where(_allowed(), self.p["move"], -1e4).astype(np.float32)
        steps, b, _ = e.shape
        back = np.zeros((steps, b, TAGS), np.int8)
        first = np.zeros(TAGS, np.float32)
        first[2::2] = -1e4
        best = e[0] + first
        for s in range(1, steps):
            x = best[:, :, None] + move
            back[s] = x.argmax(1)
            best = x.max(1) + e[s]
        tags = np.zeros((b, steps), np.int8)
        tags[:, -1] = best.argmax(1)
        for s in range(steps - 1, 0, -1):
            tags[:, s - 1] = back[s, np.arange(b), tags[:, s]]
        return tags

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the tags per row, and its gradients."""
        e, (both, sf, sb) = self.emissions(ids, True)
        steps, b, k = e.shape
        move, rows = self.p["move"], np.arange(b)
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for s in range(1, steps):
            alpha[s] = lse(alpha[s - 1][:, :, None] + move, 1) + e[s]
        for s in range(steps - 2, -1, -1):
            beta[s] = lse(move + (beta[s + 1] + e[s + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - total[None, :, None])
        gold = e[np.arange(steps)[:, None], rows, tags.T].sum(0) + move[tags[:, :-1], tags[:, 1:]].sum(1)
        pair = np.zeros((k, k))
        for s in range(1, steps):
            pair += np.exp(alpha[s - 1][:, :, None] + move + (e[s] + beta[s])[:, None, :] - total[:, None, None]).sum(0)
        np.add.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        de[np.arange(steps)[:, None], rows, tags.T] -= 1
        de /= b
        g = {"move": pair / b, "out": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, k), "out_b": de.sum((0, 1)), "e": np.zeros_like(self.p["e"])}
        dboth = de @ self.p["out"].T
        for d, saved, dh_in, order in (("f", sf, dboth[:, :, : self.h], ids), ("b", sb, dboth[::-1, :, self.h :], ids[:, ::-1])):
            dtable, dw = np.zeros((VOCAB, 4 * self.h), np.float32), np.zeros_like(self.p[f"h_{d}"])
            dh, dc = np.zeros((b, self.h), np.float32), np.zeros((b, self.h), np.float32)
            for s in range(steps - 1, -1, -1):
                i, f, o, gg, before, tc, old = saved[s]
                dh = dh + dh_in[s]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                np.add.at(dtable, order[:, s], dz)
                dw += old.T @ dz
                dh, dc = dz @ self.p[f"h_{d}"].T, dc * f
            g |= {f"h_{d}": dw, f"x_{d}": self.p["e"].T @ dtable, f"b_{d}": dtable.sum(0)}
            g["e"] += dtable @ self.p[f"x_{d}"].T
        return float((total - gold).mean()), g


# ---------------------------------------------------------------- labelled spans to train on


def labelled(rng: np.random.Generator, n: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Generated windows and their tags: words of made-up syllables with personal data and look-alikes between them."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = "an er on the de la ich ung ein que ado mente eau tion ré á ñ ö ü ss st ing ly ou re in at es".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
    name = lambda: "".join(c for c in word() if c.isascii())  or "bo"

    def email() -> str:
        a, b = pick(["@", "@", "@", " @ ", " @"]), pick([".", ".", ".", " . ", " dot "])
        return name() + pick(["", ".", "_"]) + pick(["", num(2)]) + a + name() + pick(["", num(1)]) + pick(["", "." + name()]) + b + pick(["com", "org", "net", "de", "fr"])

    def ip() -> str:
        return pick([".", ".", ".", " . ", "[.]"]).join(str(int(x)) for x in rng.integers(0, 256, 4))

    def card() -> str:
        d = num(int(pick([15, 16, 16, 16])))
        return pick([d, d, " ".join(d[k : k + 4] for k in range(0, len(d), 4)), "-".join(d[k : k + 4] for k in range(0, len(d), 4)), ".".join(d[k : k + 4] for k in range(0, len(d), 4))])

    def phone() -> str:
        lead = pick(["+" + num(1) + " ", "+" + num(2) + " ", "", "", "1-", "0"])
        return lead + pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}"])

    makers = (email, ip, card, phone)
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    like = [lambda: num(int(rng.integers(1, 7))), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f'token = "{hexes(40)}"', lambda: hexes(16), lambda: f"{num(2)}:{num(2)}", lambda: f"${num(3)}.{num(2)}", lambda: f"v{num(1)}.{num(2)}", lambda: num(25), lambda: "@" + name(), lambda: f"{name()} at {name()}"]
    ids, tags = np.zeros((n, width), np.int16), np.zeros((n, width), np.int64)
    for row in range(n):
        text, tag = "", []
        while len(text) < width + 40:
            x = rng.random()
            if x < 0.22:
                k = int(rng.integers(len(KINDS)))
                s = makers[k]()
                tag += [1 + 2 * k] + [2 + 2 * k] * (len(s) - 1)
            else:
                s = pick(like)() if x < 0.36 else word()
                tag += [0] * len(s)
            gap = pick([" ", " ", " ", " ", ", ", ". ", "\n", ": ", "### ", "!! "])
            text, tag = text + s + gap, tag + [0] * len(gap)
        at = int(rng.integers(0, 40))
        ids[row] = encode(text[at : at + width])
        cut = np.array(tag[at : at + width])
        if cut[0] and cut[0] % 2 == 0:  # a span that the window's edge cuts is no example
            end = int(np.argmax(cut != cut[0])) if (cut != cut[0]).any() else width
            cut[:end], ids[row, :end] = 0, 0
        tags[row] = cut
    return ids, tags


@functools.cache
def trained(steps: int = 260, batch: int = 48, seed: int = 5) -> Tagger:
    """The model, fitted once per process by Adam on generated labelled windows."""
    tagger, rng = Tagger(), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in tagger.p.items()}
    pool = labelled(rng, 2400)
    for step in range(1, steps + 1):
        at = rng.integers(0, len(pool[0]), batch)
        _, g = tagger.gradients(pool[0][at], pool[1][at])
        scale = min(1.0, 5.0 / float(np.sqrt(sum(float((x**2).sum()) for x in g.values()))))
        rate = 0.02 * (1 - 0.9 * step / steps)
        for k, p in tagger.p.items():
            m, v = moments[k]
            grad = g[k] * scale
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


# ---------------------------------------------------------------- whole texts


def windows(ids: np.ndarray) -> np.ndarray:
    """Starts of the windows that cover all characters near a digit or an at sign."""
    hot = np.flatnonzero(((ids >= 49) & (ids <= 58)) | (ids == 65))
    if not len(hot):
        return np.zeros(0, np.int64)
    slots = np.zeros(len(ids) // STRIDE + 2, bool)
    for shift in range(-REACH, REACH + 1, STRIDE // 2):
        slots[np.clip(hot + shift, 0, len(ids) - 1) // STRIDE] = True
    at = np.flatnonzero(slots)
    return np.unique(np.concatenate([at - 1, at, at - 2])) * STRIDE


def _spans(tags: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, kind) of the runs of begin and inside."""
    b, w = tags.shape
    row, start = np.nonzero(tags % 2 == 1)
    kind = (tags[row, start] - 1) // 2
    inside = np.zeros((b, w + 1), bool)
    inside[:, :w] = (tags > 0) & (tags % 2 == 0)
    stop = np.where(inside, w, np.arange(w + 1))
    stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    return row, start, stop[row, start + 1], kind


def _plausible(kind: int, s: str) -> bool:
    digits = sum("0" <= c <= "9" for c in s)
    if kind == 0:
        return 5 <= len(s) <= 80 and "@" in s and ("." in s or " dot " in s) and s[-1].isalnum()
    if kind == 1:
        parts = re.split(r"\s*\.\s*|\[\.\]", s)
        return len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    others = set(s) - set("0123456789 -.()+")
    return not others and s[-1].isdigit() and (13 <= digits <= 19 and _luhn(_DIGIT.sub("", s)) if kind == 2 else 10 <= digits <= 15 and len(s) - digits >= 2)


def all_spans(texts: list[str], tagger: Tagger, batch: int = 2048) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base, base and model) spans of each text."""
    base = [base_spans(x) for x in texts]
    votes: list[Counter] = [Counter() for _ in texts]
    queue: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        tags = tagger.decode(np.stack([w for _, _, w in queue]))
        for r, a, b, k in zip(*(x.tolist() for x in _spans(tags)), strict=True):
            doc, at, _ = queue[r]
            n = len(texts[doc])
            a, b = a + at, b + at
            if 0 <= a < b <= n and (a > at or at <= 0) and (b < at + WINDOW or b == n):
                votes[doc][a, k, b] += 1
        queue.clear()

    for doc, text in enumerate(texts):
        ids = encode(text)
        at = windows(ids)
        padded = np.concatenate([np.zeros(2 * STRIDE, np.int16), ids, np.zeros(WINDOW, np.int16)])
        for a in at.tolist():
            w = padded[a + 2 * STRIDE : a + 2 * STRIDE + WINDOW]
            queue.append((doc, a, w if len(w) == WINDOW else np.pad(w, (0, WINDOW - len(w)))))
            if len(queue) == batch:
                flush()
    if queue:
        flush()
    out = []
    for text, fixed, vote in zip(texts, base, votes, strict=True):
        taken: list[tuple[int, int]] = []  # disjoint, sorted
        for a, _, b in fixed:
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        added = []
        for (a, k, b), _ in sorted(vote.items(), key=lambda x: (-x[1], x[0][0] - x[0][2], x[0])):
            at = bisect_left(taken, (a, b))
            free = (at == len(taken) or taken[at][0] >= b) and (at == 0 or taken[at - 1][1] <= a)
            if free and _plausible(k, text[a:b]):
                taken.insert(at, (a, b))
                added.append((a, k, b))
        out.append((fixed, sorted(fixed + added)))
    return out


def _finder(docs: DataFrame, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list, list]]]:
    """What gives, of batches of ``docs`` with the text in column ``k``, parts with each row's spans and base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(trained().p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list]]:
        tagger = Tagger()
        tagger.p = shared.value
        hot = np.zeros(256, bool)
        hot[48:58] = hot[64] = True
        for batch in batches:
            buf, offs = t.texts(batch.column(k))
            for a, b in t.chunks(offs):
                count = np.append(0, np.cumsum(hot[buf[offs[a] : offs[b]]]))
                o = offs[a : b + 1] - offs[a]
                on = np.flatnonzero(count[o[1:]] > count[o[:-1]])
                part = batch.slice(a, b - a)
                values = part.column(k).take(pa.array(on)).to_pylist()
                found, fixed = [[]] * (b - a), [[]] * (b - a)
                for i, (x, y) in zip(on.tolist(), all_spans(values, tagger), strict=True):
                    fixed[i], found[i] = x, y
                yield part, found, fixed

    return run


def scan(docs: DataFrame, *, text: str = "text", spans: str = "spans", base: str = "base_spans") -> DataFrame:
    """``docs`` with two columns of (start, kind, end): all spans and the base ones; columns of these names are replaced."""
    docs = docs.drop(spans, base)
    found_in = _finder(docs, docs.columns.index(text))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, fixed in found_in(batches):
            cells = [pa.array([[{"start": s, "kind": n, "end": e} for s, n, e in row] for row in rows], kind) for rows in (found, fixed)]
            yield pa.RecordBatch.from_arrays([*part.columns, *cells], names=[*part.schema.names, spans, base])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    item = "array<struct<start:bigint,kind:int,end:bigint>>"
    return docs.mapInArrow(lean(run), f"{kept}, `{spans}` {item}, `{base}` {item}")


def masked(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of overlapping spans, the first's kind."""
    k = docs.columns.index(text)
    found_in = _finder(docs, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, _ in found_in(batches):
            values = part.column(k).to_pylist()
            for i, spans in enumerate(found):
                if spans:
                    parts, at = [], 0
                    for start, kind, end in spans:
                        if start >= at:
                            parts += [values[i][at:start], f"[{KINDS[kind].upper()}]"]
                        at = max(at, end)
                    values[i] = "".join(parts) + values[i][at:]
            new = pa.array(values, part.column(k).type)
            yield pa.RecordBatch.from_arrays([new if j == k else c for j, c in enumerate(part.columns)], names=part.schema.names)

    # spans are found and replaced in one pass: two passes in a stage would take a second worker for each task
    return docs.mapInArrow(lean(run), docs.schema)
