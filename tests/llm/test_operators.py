"""Training-data operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import json
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridframe.llm import bwt, components, op1_pack, op2_repeats, op3_quality, op4_jaccard, op5_tokens, op6_secrets, op7_decontaminate, op8_pii, op9_search, op10_toxicity, queries, shared
from gridframe.llm import textops as t

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, id int, shard int, `key` string, n string, gram int, _id string, v double"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def corpus():
    """Documents with shared passages, near and exact copies, and every odd case."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(150)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, long = prose(90), prose(260)
    texts = [prose(r.randint(1, 120)) for _ in range(30)] + [f"{prose(20)} {passage} {prose(30)}" for _ in range(8)]
    for k in range(12):  # a chain of near copies
        x = long.split(" ")
        for _ in range(k):
            x[r.randrange(len(x))] = "changed"
        texts.append(" ".join(x))
    texts += [None, "", " \n\t ", "!!!", "one", "Two words", "TWO WORDS", "aaaa " * 300, "x" * 5000, prose(30000), "mail bob.x@mail.example.com or +1 (279) 555-0216, 10.0.0.1", "idiot fool " * 5, texts[3], texts[3], long.upper()]
    rows = [(n, x) for n, x in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, texts[2]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, x, "en", "src", 1, "s", "p", 1, 2, "k", "n", 3, "q", 1.5) for i, x in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    rows = corpus()
    return spark.createDataFrame([(1, " ".join(rows[33][1].split(" ")[25:60])), (2, "two words"), (3, None), (4, "!!"), (None, "one"), (5, "never said at all " * 8), (11, " ".join(rows[33][1].split(" ")[25:60]))], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(n, n % 2, n % 3 == 0 and 1 or 0) for n in range(50)] + [(3, None, None), (None, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")


def counted(rows, *cols):
    return Counter(tuple(r[c] for c in cols) for r in rows)


# ---------------------------------------------------------------- 1


def best_fit_plain(lengths, sizes):
    left, bins = sum(lengths), []
    for n in lengths:
        fit = [b for b in bins if b[1] >= n]
        if fit:
            b = min(fit, key=lambda b: b[1])
        else:
            size = min((s for s in sizes if s >= n), key=lambda s: (sizes[s] / min(s, left), -s))
            b = [[], size]
            bins.append(b)
        b[0].append(n)
        b[1] -= n
        left -= n
    return sorted((tuple(b[0]), min((s for s in sizes if s >= sum(b[0])), key=lambda s: (sizes[s], s))) for b in bins)


def test_best_fit():
    r = random.Random(1)
    sizes = {8: 9.0, 16: 16.0, 32: 30.0}
    for _ in range(40):
        n = sorted((r.randint(1, 32) for _ in range(r.randint(0, 60))), reverse=True)
        which, at, final = op1_pack.best_fit(n, sizes)
        groups = {}
        for x, b, a in zip(n, which, at, strict=True):
            assert a == sum(groups.get(b, []))
            groups.setdefault(b, []).append(x)
        assert sorted((tuple(v), final[b]) for b, v in groups.items()) == best_fit_plain(n, sizes)


def test_pack(docs, empty):
    rows = op1_pack.pack(docs, sizes={64: 64.0, 256: 250.0}, shard_rows=20).collect()
    want = Counter()
    for i, x in corpus():
        want[i] += len(re.findall(r"\w+|[^\s\w]", x or ""))
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
        assert (r.bin_id is None) == (r.n_tokens == 0)
    assert got == want
    bins = {}
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault((r.bin_id, r.bin_size), []).append((r.bin_start, r.bin_start + r.n_tokens))
    for (_, size), parts in bins.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and parts[-1][1] <= size and size in (64, 256)
    assert op1_pack.pack(empty).count() == 0


# ---------------------------------------------------------------- 2


def test_bwt_merge():
    r = np.random.default_rng(0)
    for _ in range(30):
        n, m = int(r.integers(1, 40)), int(r.integers(1, 9))
        x = r.integers(1, 4, (n, m))
        order, common = bwt.sorted_strings(x)
        rows = [tuple(x[i]) for i in order]
        assert rows == sorted(map(tuple, x)) and sorted(order.tolist()) == list(range(n))
        for k in range(1, n):
            same = next((j for j in range(m) if rows[k][j] != rows[k - 1][j]), m)
            assert common[k] == same


def removed(rows, length):
    raw = [(x or "").encode() for _, x in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(mask)))
        out.append((bytes(x for x, y in zip(b, mask, strict=True) if not y), runs))
    return out


def passage_words(rows, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", low(x or "")) for _, x in rows]
    seen = Counter(run for w in words for run in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    out = Counter()
    for (doc_id, _), w in zip(rows, words, strict=True):
        hit = {p for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for p in range(i, i + n)}
        out[str(doc_id), len(hit)] += 1
    return out


@pytest.mark.parametrize("hot", [40_000, 20, 2])
def test_repeats(docs, empty, hot):
    rows = corpus()
    want = Counter((str(i), *x) for (i, _), x in zip(rows, removed(rows, 400), strict=True))
    got = op2_repeats.remove_repeats(docs, hot=hot, bucket_rows=50).collect()
    assert Counter((str(r.doc_id), bytes(r.kept), len(r.spans)) for r in got) == want
    assert Counter((str(r.doc_id), r.n_passage_words) for r in got) == passage_words(rows, 50)
    if hot == 20:
        assert op2_repeats.remove_repeats(empty).count() == 0


# ---------------------------------------------------------------- 3, 6, 10: held-out accuracy


def test_quality_edges(docs, empty, labels):
    model = op3_quality.train(docs, labels, learn=queries.F.lit(True))
    out = op3_quality.scored(docs, model).collect()
    assert len(out) == len(corpus()) and all(0 <= r.score <= 1 for r in out) and out[0].key == "k"
    same = {r.score for r in out if not r.text}
    assert len(same) == 1
    assert op3_quality.scored(empty, model).count() == 0
    none = op3_quality.train(docs, labels.limit(0), learn=queries.F.lit(True))
    assert {r.score for r in op3_quality.scored(docs, none).collect()} == {0.5}


def test_additive_model_learns_a_pair():
    r = np.random.default_rng(2)
    x = r.random((1500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = op3_quality.Model(x[:1000], y[:1000])
    assert ((m.score(x[1000:]) > 0.5) == y[1000:]).mean() > 0.9
    assert (1, 0) in m.pairs


def test_toxicity(docs, empty, labels, spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(400)]
    rows = []
    for n in range(500):
        x = [r.choice(words) for _ in range(r.randint(5, 80))]
        bad = n % 4 == 0
        for _ in range(3 if bad else 0):
            w = list(r.choice(["stupid", "moronic", "worthless"]))
            w[r.randrange(len(w))] = r.choice("stupid")  # misspelt
            x.insert(r.randrange(len(x)), "".join(w))
        rows.append((n, " ".join(x), int(bad)))
    train = spark.createDataFrame(rows[:350], "doc_id long, text string, toxic int")
    test = spark.createDataFrame(rows[350:], "doc_id long, text string, toxic int")
    model = op10_toxicity.train(train, train.select("doc_id", "toxic"), learn=queries.F.lit(True))
    got = op10_toxicity.scored(test, model).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in got]) > 0.93
    out = op10_toxicity.scored(docs, model).collect()
    assert len(out) == len(corpus()) and all(0 <= r.score <= 1 for r in out)
    assert op10_toxicity.scored(empty, model).count() == 0
    assert {r.score for r in op10_toxicity.scored(docs, op10_toxicity.train(docs, labels.limit(0), learn=queries.F.lit(True))).collect()} == {0.0}


def test_secrets(spark, docs, empty):
    key = hashlib.sha1(b"x").hexdigest()
    rows = [(1, f'the token = "{key}" is\nlong'), (2, f"commit {key} fixed it"), (3, "see /usr/lib/python3/dist-packages/index.js now"), (4, None), (5, "card 4465758382889437 of"), (6, "y" * 50)]
    got = op6_secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    assert all(text[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate for r in got)
    assert {(r.doc_id, r.is_secret) for r in got} == {(1, True), (2, False), (3, False), (5, False)}
    assert op6_secrets.scan(empty).count() == 0 and op6_secrets.scan(docs).count() >= 0
    plan = op6_secrets.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_run_is_a_candidate(spark, docs):
    r = random.Random(6)
    parts = ["3f5c9a7e1b2d4c6f8a90", "ghp_aB3dE5fG7hI9jK1mN3", "lettersonlylettersonly", "short1", "é", "😀", '"', ",", ":", " ", "\n", "&", "//host1.example.com/v1/items?token="]
    texts = ['{"api_key":"3f5c9a7e1b2d4c6f8a90","secret":"9ab1c2d3e4f5a6b7c8d9"}', "see https://host1.example.com/v1/items?token=ghp_aB3dE5fG7hI9jK1mN3", "3f5c9a7e1b2d4c6f8a90,3f5c9a7e1b2d4c6f8a90", ",".join(hashlib.md5(str(n).encode()).hexdigest() for n in range(3000))]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(200)]
    rows = [*enumerate(texts), *corpus()]
    got = op6_secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert counted(got, "doc_id", "start", "candidate") == Counter((i, m.start(), m[0]) for i, x in rows for m in re.finditer(op6_secrets.RUN, x or ""))
    assert {(x.doc_id, x.candidate) for x in got if x.is_secret} >= {(0, "9ab1c2d3e4f5a6b7c8d9")}


def test_forest_held_out(spark):
    rows = op6_secrets.labelled(spark, 3000)
    model = op6_secrets.forest(rows.limit(2000))
    from pyspark.ml.feature import VectorAssembler

    test = VectorAssembler(inputCols=list(op6_secrets.FEATURES), outputCol="x").transform(op6_secrets.features(rows.offset(2000)))
    hit = model.transform(test).selectExpr("avg(cast(prediction = label as int)) a").first().a
    assert hit > 0.95


# ---------------------------------------------------------------- 4


def shingle_sets(rows):
    out = []
    for _, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(x or ""))
        out.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    return out


def linked(rows):
    sets = shingle_sets(rows)
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                comp[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least.setdefault(root(a), []).append(i)
    names = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(i, len(sets[a]), names[root(a)] if sets[a] else i) for a, (i, _) in enumerate(rows)]


def test_near_duplicates(docs, empty, monkeypatch):
    got = op4_jaccard.near_duplicates(docs).collect()
    assert counted(got, "doc_id", "n_shingles", "component_id") == Counter(linked(corpus()))
    assert op4_jaccard.near_duplicates(empty).count() == 0


def test_first_of_each_component(spark):
    r = random.Random(12)
    prose = lambda: " ".join(r.choice("abcdefghijklmnopq") + str(r.randrange(40)) for _ in range(40))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(None, a), (3, a), (2, a + " more"), (None, a + " more"), (7, b), (7, c), (7, c), (7, c + " z"), (None, d + " y"), (None, d), (None, d), (None, e), (9, ""), (None, None), (None, " "), (4, "one"), (None, "one")]
    got = op4_jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(2, a + " more"), (7, b), (7, c), (None, d), (None, e), (9, ""), (None, None), (None, " "), (4, "one")]
    assert counted(got, "doc_id", "text") == Counter(want)


def test_longer_prefixes_lose_nothing(spark, monkeypatch):
    r = random.Random(9)
    words = [str(n) for n in range(60)]
    base = [r.choice(words) for _ in range(80)]
    rows = []
    for n in range(60):
        x = list(base)
        for _ in range(r.randint(0, 5)):
            x[r.randrange(len(x))] = r.choice(words)
        rows.append((n, " ".join(x[: r.randint(55, 80)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1, 3):
        monkeypatch.setattr(op4_jaccard, "choose_matches", lambda n, p, most=most: min(most, int(-(-3 * n // 4))))
        got = op4_jaccard.near_duplicates(frame).collect()
        assert counted(got, "doc_id", "n_shingles", "component_id") == Counter(linked(rows))


def test_hot_shingles_and_wide_groups(spark, monkeypatch):
    """Bounds set so low that shingles are dealt out, cut into blocks, compared by bitmaps and verified in small teams."""
    r = random.Random(10)
    rows = []
    for base in ([str(r.randrange(10**6)) for _ in range(n)] for n in (40, 300, 1200)):
        for _ in range(25):
            x = list(base)
            for _ in range(r.randint(0, len(base) // 25)):
                x[r.randrange(len(x))] = str(r.randrange(10**6))
            rows.append((len(rows), " ".join(x)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter(linked(rows))
    assert len({c for _, _, c in want}) > 3
    for light, hot in ((2, 2), (10**6, 10**6)):
        for name, value in (("LIGHT", light), ("HOT", hot), ("GROUP", 2), ("SPREAD", 2), ("LEAD", 3), ("PAIRS", 50), ("ENTRIES", 100)):
            monkeypatch.setattr(op4_jaccard, name, value)
        # without pivots every link is left to the pairs across components
        monkeypatch.setattr(op4_jaccard, "_star", lambda postings: postings.select(F.col("k1").alias("x"), F.col("k1").alias("y")).limit(0))
        assert counted(op4_jaccard.near_duplicates(frame).collect(), "doc_id", "n_shingles", "component_id") == want


def test_bitmaps_never_overstate():
    r = random.Random(11)
    sizes = [60, 200, 256, 257, 300, 1024, 1025, 1300]
    texts = []
    for n in sizes:
        base = [str(r.randrange(10**6)) for _ in range(n + 4)]
        texts += [" ".join(base), " ".join(base[: len(base) * 5 // 6]), " ".join(base[len(base) // 5 :])]
    buf, offs = t.texts(pa.array(texts))
    s = op4_jaccard.Sets(buf, offs, None)
    maps = op4_jaccard.Bitmaps(np.array(s.bitmaps().to_pylist(), object), s.size)
    i, j = (x.ravel() for x in np.indices((len(texts), len(texts))))
    ok = 4 * np.minimum(s.size[i], s.size[j]) >= 3 * np.maximum(s.size[i], s.size[j])
    i, j = i[ok], j[ok]
    sets = [set(s.hash[a:b].tolist()) for a, b in zip(s.first[:-1], s.first[1:])]
    real = np.array([len(sets[a] ^ sets[b]) for a, b in zip(i, j)])
    bound = maps.differences(i, j)
    assert (bound <= real).all() and (bound[real == 0] == 0).all() and bound.sum() > 0.3 * real.sum()


def test_words_of_one_length_that_polynomials_confuse():
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    words = t.Words(*t.texts(pa.array([f"{x} {y} {x}", "q" * 300 + " " + "q" * 301])), t.NON_SPACE)
    assert words.hash[0] == words.hash[2] and len(set(words.hash.tolist())) == 4
    index = op7_decontaminate.Index(["1"], [x], 13)
    index.choose({})
    assert index.matches(t.Words(*t.texts(pa.array([y, x])), t.ALNUM))[1].tolist() == [1]
    # a hash that clashes for all words of one length: bytes decide
    def clash(low, start, end):
        return (end - start).astype(np.uint64)

    old, t.word_hashes = t.word_hashes, clash
    try:
        index = op7_decontaminate.Index(["1", "2"], ["ab cd ef", "ab cd eg"], 13)
        index.choose({})
        window, at = index.matches(t.Words(*t.texts(pa.array(["zz ab cd eg", "ab ce ef"])), t.ALNUM))
        assert at.tolist() == [1] and index.items[window].tolist() == [1]
    finally:
        t.word_hashes = old


def test_components(spark):
    edges = [(n, n + 1) for n in range(20)] + [(30, 31), (33, 31), (40, 40)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(21)} | {30: 30, 31: 30, 33: 30}


# ---------------------------------------------------------------- 5


def test_very_long_blanks_and_words():
    with open(op5_tokens.TOKENIZER, "rb") as f:
        encoder = op5_tokens.Encoder(f.read())
    for text in (" " * 1_000_000, "a" + " " * 1_000_000 + "b", "\u3000" * 400_000, "a" * 1_000_000):
        assert encoder.ends(text)[-1] == len(text.encode())


def test_long_blanks_are_cut_out_as_the_pattern_cuts_them(monkeypatch):
    monkeypatch.setattr(op5_tokens, "BLANKS", re.compile(op5_tokens.BLANKS.pattern.replace("10000", "3")))
    with open(op5_tokens.TOKENIZER, "rb") as f:
        encoder = op5_tokens.Encoder(f.read())
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice([" " * r.randint(1, 40), "\n" * r.randint(1, 9), "\t\u3000\u2009 \xa0", "word", "\u00c9a", "'s", "12", "!?"]) for _ in range(r.randint(1, 9)))
        assert encoder.encode(text) == encoder.encoding.encode_ordinary(text)


@pytest.mark.parametrize("rule", op5_tokens.RULES)
def test_attribution(rule):
    r = random.Random(5)
    for _ in range(100):
        ends = np.cumsum([r.randint(1, 4) for _ in range(r.randint(1, 30))])
        starts = np.array(sorted({0, *(r.randrange(int(ends[-1])) for _ in range(5))}))
        got, _ = op5_tokens.attribute(ends, starts, rule)
        want = np.zeros(len(starts))
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            at = [int(np.searchsorted(starts, x, "right")) - 1 for x in range(a, b)]
            share = Counter(at)
            if rule == "start":
                want[at[0]] += 1
            elif rule == "most":
                want[max(share, key=lambda k: (share[k], -k))] += 1
            else:
                for k, n in share.items():
                    want[k] += n / len(at)
        assert np.allclose(got, want)


def test_token_counts(docs, empty):
    enc = op5_tokens.Encoder(open(op5_tokens.TOKENIZER, "rb").read()).encoding
    got = op5_tokens.count_tokens(docs).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    want = Counter()
    for i, x in corpus():
        if x:
            want[i] += len(enc.encode_ordinary(x))
    assert total == want
    two = op5_tokens.count_tokens(docs, fields=("source", "text"), by_line=False, joint="\n\n").where("doc_id = 0").collect()
    assert [r.field for r in two] == ["source", None, "text"] and two[-1].end == 5 + len(corpus()[0][1])
    assert op5_tokens.count_tokens(empty).count() == 0
    with pytest.raises(ValueError, match="rule"):
        op5_tokens.count_tokens(docs, rule="x")


# ---------------------------------------------------------------- 7

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(rows, items, window=13):
    held = {}
    for i, x in items:
        w = WORD.findall(low(x or ""))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            held.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    out = []
    for i, x in rows:
        w, hit, ids = WORD.findall(low(x or "")), set(), set()
        for n in {len(k) for k in held}:
            for a in range(len(w) - n + 1):
                if found := held.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 20, 100])
def test_decontaminate(docs, empty, items, slice_bytes):
    pairs = [(r.item_id, r.text) for r in items.collect()]
    got = op7_decontaminate.report(op7_decontaminate.overlaps(docs, items, slice_bytes=slice_bytes)).collect()
    assert counted(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == Counter(hits(corpus(), pairs))
    assert sum(r.n_hit > 0 for r in got) > 3
    assert op7_decontaminate.report(op7_decontaminate.overlaps(empty, items)).count() == 0
    assert op7_decontaminate.report(op7_decontaminate.overlaps(docs, items.limit(0))).where("n_hit > 0").count() == 0


# ---------------------------------------------------------------- 8

KIND = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(x):
    out = []
    for k, kind in enumerate(KIND):
        for m in re.finditer(KIND[kind], x):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + n % 2), 10)) for n, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    r = random.Random(8)
    for _ in range(3000):
        x = "".join(r.choice("ab.@-+ 0123456789()%é") for _ in range(r.randint(0, 60)))
        assert op8_pii.base_spans(x) == plain_spans(x), x
    for x in ("a@b@c.d.e", "1.2.3.4.5.6.7.8", "+1 279 555 0216 +1 279 555 0217", "0000001.2.3.4", "4465758382889437 4465758382889437", "a@b.c.d@e.f", "@" * 50, "1" * 300):
        assert op8_pii.base_spans(x) == plain_spans(x), x
    assert op8_pii.base_spans("a" * 300_000 + "1" * 300_000) == []


def test_tagger_gradients():
    m = op8_pii.Tagger(dim=3, hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids, tags = op8_pii.labelled(np.random.default_rng(1), 3, 12)
    _, g = m.gradients(ids, tags)
    r = np.random.default_rng(2)
    for k in ("h_f", "x_b", "move", "out", "b_f"):
        at = tuple(int(r.integers(n)) for n in m.p[k].shape)
        was = m.p[k][at]
        m.p[k][at] = was + 1e-4
        up = m.gradients(ids, tags)[0]
        m.p[k][at] = was - 1e-4
        down = m.gradients(ids, tags)[0]
        m.p[k][at] = was
        assert (up - down) / 2e-4 == pytest.approx(g[k][at], rel=0.02, abs=2e-5)


def test_model_finds_labelled_spans():
    m = op8_pii.trained()
    ids, tags = op8_pii.labelled(np.random.default_rng(77), 300)
    got = m.decode(ids)
    assert (got == tags)[tags > 0].mean() > 0.9 and (got == tags).mean() > 0.95


def test_scan_and_mask(docs, empty):
    got = op8_pii.scan(docs).collect()
    want = Counter((str(i), json.dumps(plain_spans(x or ""))) for i, x in corpus())
    assert Counter((str(r.doc_id), json.dumps([(s.start, s.kind, s.end) for s in r.base_spans])) for r in got) == want
    for r in got:
        assert {tuple(s) for s in r.base_spans} <= {tuple(s) for s in r.spans}
    (text,) = [r.text for r in op8_pii.masked(docs.select("doc_id", "text")).collect() if r.text and "[EMAIL]" in r.text]
    assert text == "mail [EMAIL] or [PHONE], [IP]"
    assert op8_pii.scan(empty).count() == 0 and op8_pii.masked(empty).count() == 0


# ---------------------------------------------------------------- 9


def bm25(rows, asked, k):
    words = [WORD.findall(low(x or "")) for _, x in rows]
    tf = [Counter(w) for w in words]
    df = Counter(x for c in tf for x in c)
    n, mean = len(rows), sum(map(len, words)) / len(rows)
    out = {}
    for q in asked:
        terms = set(words[q])
        scores = []
        for (i, _), c, w in zip(rows, tf, words, strict=True):
            s = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in terms & c.keys())
            if s > 0:
                scores.append((-round(s, 5), i is not None, i))
        out[rows[q][0]] = [(n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.mark.parametrize("shard_rows", [7, 1000])
def test_search(docs, empty, shard_rows):
    rows = corpus()
    asked = [n for n in range(0, 60, 5) if rows[n][1]]
    got = op9_search.search(docs, is_query=queries.F.col("doc_id").isin([rows[n][0] for n in asked if rows[n][0] != 5]), k=4, shard_rows=shard_rows).collect()
    want = bm25(rows, [n for n in asked if rows[n][0] != 5], 4)
    for q, best in want.items():  # ids, ranks and scores, ties and repeated rows included
        assert sorted((r.rank, r.doc_id, r.score) for r in got if r.query_id == q) == best
    assert op9_search.search(empty, is_query=queries.F.lit(True)).count() == 0


def test_pruned_search_is_exact():
    r = np.random.default_rng(3)
    n, v = 3000, 500
    parts = []
    for d in range(n):
        terms = np.unique(r.integers(0, v, 3 if d % 50 else 40))
        parts.append((np.zeros(len(terms), np.int32), terms.astype(np.int64), np.ones(len(terms), np.float32), np.array([len(terms)])))
    vectors = [dict.fromkeys(p[1].tolist()) for p in parts]
    shard = op9_search.Shard(list(parts), 4.0)
    for _ in range(20):
        q = np.unique(r.integers(0, v, 12)).astype(np.int64)
        w = r.random(len(q)) + 0.1
        rows, scores = shard.top(q, w, 10)
        full = np.array([sum(float(w[k]) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(x) / 4.0)) for k, t_ in enumerate(q.tolist()) if t_ in x) for x in vectors])
        assert np.allclose(np.sort(scores)[::-1][:10], np.sort(full)[::-1][:10], atol=1e-4)
        assert np.allclose(full[rows], scores, atol=1e-4)


@pytest.mark.parametrize("round_terms", [150, 10**6])
def test_search_by_rounds_sends_no_query_to_every_shard(docs, round_terms):
    rows = corpus()
    asked = [n for n in range(0, 60, 5) if rows[n][1] and rows[n][0] != 5]
    got = op9_search.search(docs, is_query=queries.F.col("doc_id").isin([rows[n][0] for n in asked]), k=4, shard_rows=3, round_terms=round_terms)
    plan = got._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = got.collect()
    for q, best in bm25(rows, asked, 4).items():
        assert sorted((r.rank, r.doc_id, r.score) for r in got if r.query_id == q) == best


def test_queries_scored_together_agree_with_one_by_one():
    import pyarrow as pa

    r = np.random.default_rng(4)
    parts, vectors = [], []
    for d in range(900):  # few common terms for the matrix product, many rare ones for posting lists; every ninth row is a copy
        x = vectors[-1] if d % 9 == 1 else np.unique(np.append(r.integers(0, 12, 8), 12 + r.integers(0, 4000, 20)))
        vectors.append(x)
        parts.append((np.zeros(len(x), np.int32), x.astype(np.int64), np.ones(len(x), np.float32), np.array([len(x)])))
    vocabulary, listed = np.arange(0, 4012, dtype=np.int64), vectors[:700]
    weight = np.where(vocabulary < 12, 0.3, 4.0) + vocabulary / 1e5
    first = np.append(0, np.cumsum([len(x) for x in listed]))
    asked = op9_search.Asked(pa.nulls(len(listed)), first, np.concatenate(listed).astype(np.int32), vocabulary, weight)
    holds = np.zeros((len(vectors), len(vocabulary)))
    for d, x in enumerate(vectors):
        holds[d, x] = 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(x) / 24.0))
    score = np.array([holds[:, x] @ weight[x] for x in listed])
    score, order = np.round(score, op9_search.PLACES), np.arange(len(vectors))[::-1].copy()
    want = [np.lexsort((order, -s))[:5].tolist() for s in score]
    floor = np.array([s[w[2]] for s, w in zip(score, want, strict=True)])
    for least in (np.zeros(len(listed)), floor):
        got = [[] for _ in listed]
        for query, row, _ in op9_search.Shard(list(parts), 24.0).best(asked, 5, order, least):
            for q, d in zip(query.tolist(), row.tolist(), strict=True):
                got[q].append(d)
        assert got == [[d for d in w if score[q, d] >= least[q]] for q, w in enumerate(want)]


def made_rows(spark, since, node="MapInArrow", holds="query_id"):
    """Rows that these nodes of the SQL executions from ``since`` on have put out."""
    store, total, seen = spark._jsparkSession.sharedState().statusStore(), 0, set()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    for run in (runs.apply(i) for i in range(since, runs.size())):
        nodes, values = store.planGraph(run.executionId()).allNodes(), store.executionMetrics(run.executionId())
        for x in (nodes.apply(i) for i in range(nodes.size())):
            if node in x.name() and holds in x.desc():
                for m in (x.metrics().apply(i) for i in range(x.metrics().size())):
                    if m.name() == "number of output rows" and m.accumulatorId() not in seen and values.contains(m.accumulatorId()):
                        seen.add(m.accumulatorId())
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


@pytest.mark.parametrize("copies", [0, 320])
def test_search_rows_grow_with_the_logarithm_of_shards(spark, copies):
    r = random.Random(copies)
    words = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(60)]
    rows = [(n, "the same text" if n % 2 and n < 2 * copies else " ".join(r.choice(words) for _ in range(12))) for n in range(640)]
    asked = [n for n in range(0, 640, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = op9_search.search(df, is_query=queries.F.col("doc_id") % 9 == 0, k=4, shard_rows=20).collect()
    made = made_rows(spark, since)
    assert len(got) <= made <= 1.4 * len(asked) * 4 * (op9_search.AHEAD + 3)  # 32 shards: 4 without a floor, then three stages
    for q, best in bm25(rows, asked, 4).items():
        assert sorted((x.rank, x.doc_id, x.score) for x in got if x.query_id == q) == best
    assert op9_search.stages(32) == [(0, 4), (4, 8), (8, 16), (16, 32)] and op9_search.stages(7) == [(0, 3), (3, 7)] and op9_search.stages(1) == [(0, 1)]


# ---------------------------------------------------------------- shared parts, queries, pipeline


def test_words_and_chunks():
    import pyarrow as pa

    texts = [None, "", "Hé llo\tWORLD", "a" * 3000, "x y", " "]
    buf, offs = t.texts(pa.array(texts))
    w = t.Words(buf, offs, t.NON_SPACE)
    assert np.diff(w.first).tolist() == [0, 0, 3, 1, 2, 0]
    assert list(t.chunks(offs, 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    again = t.Words(*t.texts(pa.array(["world hé"])), t.NON_SPACE)
    assert again.hash.tolist() == [w.hash[2], w.hash[0]]


def test_stored_folder(spark, tmp_path, monkeypatch):
    assert shared.scratch(spark)
    monkeypatch.setattr(shared, "scratch", lambda s: f"file://{tmp_path}")
    df = shared.stored(spark.range(3), "x")
    assert df.count() == 3 and list(tmp_path.iterdir())
    shared.discard(df)
    assert not [x for x in tmp_path.iterdir() if not x.name.endswith(".crc")]


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads /proc")
def test_worker_gives_memory_back_after_a_task():
    def own():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) / 1024

    pins = []

    def run(batches):
        held = []
        for _ in range(1000):  # small pieces that last keep the C allocator from shrinking by itself
            held.append(np.ones(60 << 10, np.uint8))
            pins.append(np.ones(2000, np.uint8))
        yield from batches

    before = own()
    assert list(run([1, 2])) == [1, 2]
    kept = own() - before
    assert list(shared.lean(run)([1, 2])) == [1, 2]
    assert kept > 30 and own() - before < 20


def test_pipeline_takes_one_worker_a_task(docs, items, tmp_path, spark):
    import corpus_pipeline as c

    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (c.decontaminate, c.private):
        plan = stage(spark, docs, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


@needs_data
def test_queries_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_pipeline_keeps_one_row_of_each_component(docs, tmp_path, spark):
    import corpus_pipeline as c

    rows = corpus()
    kept = c.near_duplicates(spark, docs, str(tmp_path)).collect()
    groups = {n for (_, x), (_, _, n) in zip(rows, linked(rows), strict=True) if x and x.strip()}
    without = Counter((i, x) for i, x in rows if not (x and x.strip()))
    assert Counter((r.doc_id, r.text) for r in kept) == without + Counter(next((i, x) for i, x in rows if i == n) for n in groups)


def test_pipeline_stages(docs, items, labels, tmp_path, spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality", "near_duplicates", "decontaminate", "private", "packed"]
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        assert tuple(stage(spark, docs, str(tmp_path)).columns) == c.COLUMNS
    kept = c.near_duplicates(spark, docs, str(tmp_path)).collect()
    want = {x for i, n, x in linked(corpus()) if i is not None} & {i for i, _ in corpus()}
    assert {r.doc_id for r in kept if r.doc_id is not None} == want and len([r for r in kept if r.doc_id is not None]) == len(want)
    clean = c.decontaminate(spark, docs, str(tmp_path)).collect()
    bad = Counter(i for i, *_, dirty in hits(corpus(), [(r.item_id, r.text) for r in items.collect()]) if dirty)
    assert Counter(r.doc_id for r in clean) == Counter(i for i, _ in corpus()) - bad
    out = c.run(spark, str(tmp_path))
    assert out.count() > 0 and "bin_id" in out.columns
