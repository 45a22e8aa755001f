"""Operators against numpy on small arrays."""

import math

import numpy as np
import pytest

import gridframe as g
from gridframe.plans.expr import as_expr, formula, leaves, slots
from gridframe.plans.frame import ShapeError

i, j, k = g.Ix("i"), g.Ix("j"), g.Ix("k")
NAN = float("nan")


@pytest.fixture(scope="module")
def a(spark):
    return g.literal(spark, np.arange(12.0).reshape(3, 4))


@pytest.fixture(scope="module")
def v(spark):
    return g.literal(spark, [3.0, -1.0, 4.0, 1.0, -5.0])


def test_elementwise_and_reorder(spark, a):
    n = np.arange(12.0).reshape(3, 4)
    assert np.array_equal((a + a * 2).eval().numpy(), 3 * n)
    assert np.array_equal(a[i, j].eval((j, i)).numpy(), n.T)
    assert np.array_equal((a[i, j] - 1.0).eval().numpy(), n - 1)
    assert a.at(2, 1) == 9.0


def test_c_arithmetic(spark):
    x, y = g.literal(spark, [-7, 7, -7, 5], dtype="int"), g.literal(spark, [2, -2, -2, 3], dtype="int")
    assert (as_expr(x) / y).eval().numpy().tolist() == [-3, -3, 3, 1]
    assert (as_expr(x) % y).eval().numpy().tolist() == [-1, 1, -1, 2]
    big = g.literal(spark, [2**31 - 1], dtype="int")
    assert (big + 1).eval().numpy().tolist() == [-(2**31)]
    p, q = g.literal(spark, [1.0, -1.0, 0.0, 1.0]), g.literal(spark, [0.0, 0.0, 0.0, NAN])
    got = (as_expr(p) / q).eval().numpy()
    assert got[0] == math.inf and got[1] == -math.inf and np.isnan(got[2:]).all()
    assert not (as_expr(q) == q).eval().numpy()[3] and (as_expr(q) != q).eval().numpy()[3]


def test_folds(spark, a, v):
    n, x = np.arange(12.0).reshape(3, 4), np.array([3.0, -1, 4, 1, -5])
    assert np.array_equal(g.fold(a[i, j] * a[k, j], j).eval().numpy(), n @ n.T)
    assert np.array_equal(g.fold(a, 0, op=g.Max).eval().numpy(), n.max(0))
    assert g.fold(v, op=g.Mul).eval().item() == pytest.approx(x.prod())
    assert g.math.sqrt(g.fold(v[i] * v[i])).eval().item() == pytest.approx(np.linalg.norm(x))
    assert tuple(g.fold(v, op=g.ArgMin).eval().item()) == (-5.0, 4)
    assert tuple(g.fold(a, op=g.ArgMax).eval().item()) == (11.0, 11)
    assert tuple(g.fold(v, op=g.Welford).eval().item()) == pytest.approx((x.mean(), x.var(ddof=1)))


def test_nan_loses_and_ties_go_low(spark):
    x = g.literal(spark, [NAN, 2.0, 5.0, 5.0, NAN])
    assert g.fold(x, op=g.Max).eval().item() == 5.0 and g.fold(x, op=g.Min).eval().item() == 2.0
    assert tuple(g.fold(x, op=g.ArgMax).eval().item()) == (5.0, 2)
    empty = g.literal(spark, [NAN, NAN])
    assert g.fold(empty, op=g.Max).eval().item() == -1.7976931348623157e308
    lo, hi = g.fold(empty, op=g.MinMax).eval().item()
    assert math.isnan(lo) and math.isnan(hi)
    assert g.fold(empty, op=g.ArgMax).eval().item()["at"] == 2**32 - 1


def test_boundaries(spark):
    p = g.literal(spark, [1.0, 2.0, 3.0, 4.0])
    shift = lambda at: (p[at(i - 1)] + 0 * p[i]).eval().numpy().tolist()
    assert shift(g.zero) == [0, 1, 2, 3] and shift(g.clamp) == [1, 1, 2, 3] and shift(g.wrap) == [4, 1, 2, 3]
    assert shift(lambda t: g.pad(t, 9.0)) == [9, 1, 2, 3]
    assert (p[g.wrap(2 * i)] + 0 * p[i]).eval().numpy().tolist() == [1, 3, 1, 3]
    at = g.literal(spark, [-0.5, 1.9, 7.0])
    assert p[g.clamp(at[i])].eval().numpy().tolist() == [1, 2, 4]
    full = g.fold(p[g.zero(k - j)] * p[j], j)
    assert full.eval().numpy().tolist() == np.convolve([1, 2, 3, 4], [1, 2, 3, 4])[:4].tolist()


def test_scatters(spark, v):
    cell = g.literal(spark, [2, 0, 2, 1, 9], dtype="int")
    load = g.literal(spark, [1.0, 2, 3, 4, 5])
    assert g.scatter(g.clamp(cell[i], 3), load[i]).eval().numpy().tolist() == [2, 4, 9]
    assert g.scatter(g.drop(cell[i], 4), load[i]).eval().numpy().tolist() == [2, 4, 4, 0]
    assert g.scatter(g.wrap(cell[i], 3), load[i], op=g.Max).eval().numpy().tolist() == [5, 4, 3]
    assert g.scatter(g.wrap(i, 2), load[i]).eval().numpy().tolist() == [9, 6]
    assert g.scatter(g.drop(g.bins(i, 2)), load[i]).eval().numpy().tolist() == [6, 9]
    assert g.scatter(g.drop(g.cuts(i, (0, 1, 5))), load[i]).eval().numpy().tolist() == [1, 14]
    one = g.scatter(g.drop(cell[i], 4), load[i], op=g.Welford).eval()
    assert math.isnan(one.field("mean").numpy()[3]) and math.isnan(one.field("var").numpy()[0])
    e = g.literal(spark, np.arange(10.0).reshape(5, 2))
    assert g.scatter(g.drop(cell[i], 3), e[i, j], i).eval().numpy().tolist() == [[2, 3], [6, 7], [4, 6]]


def test_bins_and_cuts_edges(spark):
    x = g.literal(spark, [-0.1, 0.0, 0.5, 1.0, 2.0, NAN])
    assert g.evaluate(g.bins(x, 0.0, 1.0, 4)).numpy()[:5].tolist() == [-1, 0, 2, 4, 8]
    assert g.evaluate(g.cuts(x, (0.0, 1.0, 2.0))).numpy().tolist() == [-1, 0, 0, 1, 2, -1]


def test_scans(spark, a):
    n = np.arange(12.0).reshape(3, 4)
    assert np.array_equal(g.scan(a[i, j], j).eval().numpy(), n.cumsum(1))
    assert np.array_equal(g.scan(a[i, j], i, g.Max).eval().numpy(), np.maximum.accumulate(n, 0))
    s = g.scan(a[0, j], j, g.Mul)
    assert s.eval().numpy().tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize("op", [g.Add, g.Max, g.Mul])
def test_two_level_scan(spark, monkeypatch, op):
    from gridframe.plans import lower

    monkeypatch.setattr(lower, "SCAN_BLOCK", 4)
    x = np.array([1.5, -1, 2, 1, 1, 3, -2, 1, 1, 2, 1])
    want = {"+": np.cumsum(x), "max": np.maximum.accumulate(x), "*": np.cumprod(x)}[op.name]
    assert np.allclose(g.scan(g.literal(spark, x)[i], i, op).eval().numpy(), want)


def test_user_op_and_map(spark, v):
    op = g.user_op("longest", lambda p, q: __import__("pyspark.sql.functions", fromlist=["x"]).greatest(p, q), 0.0)
    assert g.fold(v, op=op).eval().item() == 4.0
    assert g.scan(v[i], i, op).eval().numpy().tolist() == [3, 3, 4, 4, 4]
    assert g.map_by(lambda x: x**2, v).eval().numpy().tolist() == [9, 1, 16, 1, 25]


def test_generators(spark):
    assert g.gen.linspace(spark, 5, 0.0, 1.0).eval().numpy().tolist() == [0, 0.25, 0.5, 0.75, 1]
    assert g.gen.iota(spark, (2, 2), 3).eval().numpy().tolist() == [[3, 4], [5, 6]]
    assert g.gen.linspace(spark, 1, 2.0, 9.0).eval().numpy().tolist() == [2]


def test_philox_vectors():
    from gridframe.sources.generators import philox

    one = lambda c, key: [int(x[0]) for x in philox([np.array([w]) for w in c], key)]
    assert one([0] * 4, [0] * 2) == [0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8]
    assert one([0xFFFFFFFF] * 4, [0xFFFFFFFF] * 2) == [0x408F276D, 0x41C83B0E, 0xA20BC7C6, 0x6D5451FD]
    assert one([0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344], [0xA4093822, 0x299F31D0]) == [0xD16CFE09, 0x94FDCCEB, 0x5001E420, 0x24126EA1]


def test_sampling_depends_on_seed_and_cell_only(spark):
    def draw(n, parts):
        g.gen.seed(5)
        a = g.gen.uniform(spark, (n,)).eval()
        return a.df.repartition(parts).orderBy("d0").toPandas()["v"].to_numpy()

    assert np.array_equal(draw(100, 1), draw(100, 7))
    assert np.array_equal(draw(50, 2), draw(100, 2)[:50])
    g.gen.seed(5)
    z = g.gen.sample(spark, (200,), lambda s: next(x for x in iter(s.uniform, None) if x > 0.5)).eval().numpy()
    assert z.min() > 0.5
    c = g.gen.choice(spark, (500,), [1.0, 2.0], [0, 1]).eval().numpy()
    assert set(c.tolist()) == {2.0}


def test_statistics(spark, v):
    h = g.stats.histogram(v, 3)
    assert h.counts.numpy().tolist() == np.histogram([3, -1, 4, 1, -5], 3)[0].tolist()
    assert np.allclose(h.edges.numpy(), np.histogram([3, -1, 4, 1, -5], 3)[1])
    flat = g.stats.histogram(g.literal(spark, [2.0, 2.0]), 4)
    assert flat.edges.numpy()[[0, -1]].tolist() == [1.5, 2.5] and flat.counts.numpy().sum() == 2
    assert g.stats.mean(g.literal(spark, [1, 2], dtype="int")).item() == 1.5
    assert g.stats.std(v).item() == pytest.approx(np.std([3, -1, 4, 1, -5], ddof=1))


def test_files(spark, tmp_path, a):
    p = str(tmp_path / "a.npy")
    g.npy.save(p, a)
    want = tmp_path / "want.npy"
    np.save(want, np.arange(12.0).reshape(3, 4))
    assert open(p, "rb").read() == want.read_bytes()
    assert np.array_equal(g.npy.load(spark, p).numpy(), np.load(p))
    with pytest.raises(g.npy.FileError, match="shape"):
        g.npy.load(spark, p, shape=(4, 3))
    with pytest.raises(g.npy.FileError, match="dtype"):
        g.npy.load(spark, p, dtype="int")
    z = str(tmp_path / "z.npz")
    g.npy.savez(z, {"a": a, "b": g.literal(spark, [1, 2, 3], dtype="int")})
    assert np.array_equal(np.load(z)["b"], [1, 2, 3])
    got = g.npy.loadz(spark, z, {"a": (None, None), "b": ("int", (3,))})
    assert got["b"].numpy().tolist() == [1, 2, 3] and got["a"].shape == (3, 4)
    with pytest.raises(g.npy.FileError, match="no field"):
        g.npy.loadz(spark, z, {"c": (None, None)})
    np.save(want, np.asfortranarray(np.ones((2, 3))))
    with pytest.raises(g.npy.FileError, match="columns first"):
        g.npy.load(spark, str(want))


def test_tables(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "k long, x double")
    assert g.from_table(df, ["k"], "x").numpy().tolist() == [1, 2, 3]
    for rows in ([(0, 1.0), (2, 1.0)], [(0, 1.0), (0, 1.0)], [(0, 1.0), (1, 1.0), (1, 1.0), (3, 1.0)], [(-1, 1.0)]):
        with pytest.raises(ShapeError):
            g.from_table(spark.createDataFrame(rows, "k long, x double"), ["k"], "x")
    holes = g.from_table(df.where("k <> 1"), ["k"], "x", fill=-1.0)
    assert holes.numpy().tolist() == [1, -1, 3]


def test_same_source_needs_no_join(spark, capsys):
    df = spark.createDataFrame([(n, float(n), 2.0) for n in range(5)], "k long, x double, y double")
    a = g.from_table(df, ["k"], "x")
    b = a.with_value(df["y"], "double")
    plan = (a[i] * b[i] + a[i]).eval().df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_partition_counts_do_not_matter(spark):
    df = spark.range(200).selectExpr("id as k", "id % 7 as x")
    got = []
    for n in (1, 4, 16):
        a = g.from_table(df.repartition(n), ["k"], "x")
        got.append(g.scatter(g.wrap(a[i], 7), a[i], op=g.Add).eval().numpy().tolist())
    assert got[0] == got[1] == got[2]


def test_looking_at_expressions(spark, a, v):
    e = g.math.tanh(g.fold(a[i, j] * 2.0 * v[g.clamp(j)], j))
    assert formula(e) == "tanh(+/i0(((in0[i1,i0] * s0) * in1[clamp5(i0)])))"
    assert (slots(e).views, slots(e).scalars) == (2, 1)
    assert formula(g.scatter(g.clamp(v[i], 3), v[i])) == "+>i0[clamp3(in0[i0])](in1[i0])"
    assert len(list(leaves(e))) == 3


def test_special_functions_against_quadrature():
    from gridframe.functions import special as s

    t = np.linspace(0, 1.0, 20001)
    w = np.full(len(t), t[1])
    w[[0, -1]] /= 2
    for kk, nu in ((0.5, 0.3), (0.9, -0.5)):
        root = np.sqrt(1 - (kk * np.sin(t)) ** 2)
        assert s.ellint_1(kk, 1.0) == pytest.approx((w / root).sum(), rel=1e-7)
        assert s.ellint_2(kk, 1.0) == pytest.approx((w * root).sum(), rel=1e-7)
        assert s.ellint_3(kk, nu, 1.0) == pytest.approx((w / root / (1 - nu * np.sin(t) ** 2)).sum(), rel=1e-7)
    assert s.bessel_j(0, 1) == pytest.approx(0.7651976865579666) and s.bessel_y(0, 1) == pytest.approx(0.08825696421567697)
    assert s.bessel_k(0, 1) == pytest.approx(0.42102443824070834) and s.bessel_i(1, 2) == pytest.approx(1.5906368546373291)
    assert s.zeta(2) == pytest.approx(math.pi**2 / 6) and s.expint(1) == pytest.approx(1.8951178163559368)
    assert s.ellint_1(0.5, math.pi / 2) == pytest.approx(s.comp_ellint_1(0.5))


REJECTED = [
    ("shapes differ", lambda s, a, v: a + v),
    ("subscript it", lambda s, a, v: a + v[i]),
    ("name a boundary", lambda s, a, v: v[i + 1]),
    ("constant subscript", lambda s, a, v: a[3, j]),
    ("subscripts for", lambda s, a, v: a[i]),
    ("has extent", lambda s, a, v: a[i, i] + a[j, i] if False else a[i, j] * v[j]),
    ("one fold", lambda s, a, v: g.fold(v[i]) + g.fold(v[i])),
    ("inner one first", lambda s, a, v: g.fold(g.fold(a[i, j], j), i)),
    ("folded twice", lambda s, a, v: g.fold(v[i], i, i)),
    ("not mixed", lambda s, a, v: g.fold(a[i, j], i, 0)),
    ("by axis numbers", lambda s, a, v: g.fold(a, i)),
    ("axes of", lambda s, a, v: g.fold(a, 2)),
    ("does not occur", lambda s, a, v: g.fold(v[i], j)),
    ("extent of index", lambda s, a, v: g.fold(v[g.clamp(2 * i)], i)),
    ("zero boundary", lambda s, a, v: g.fold(v[g.zero(i - 1)] * v[i], i, op=g.Max)),
    ("names its policy", lambda s, a, v: g.scatter(v[i], v[i])),
    ("wrap, clamp, drop", lambda s, a, v: g.scatter(g.zero(v[i]), v[i])),
    ("no destination", lambda s, a, v: g.scatter(g.clamp(i + 1, 3), v[i])),
    ("destination is not known", lambda s, a, v: g.scatter(g.clamp(v[i]), v[i])),
    ("groups of", lambda s, a, v: g.scatter(g.drop(g.bins(i, 9)), v[i])),
    ("do not cover", lambda s, a, v: g.scatter(g.drop(g.cuts(i, (0, 2))), v[i])),
    ("must increase", lambda s, a, v: g.cuts(i, (0, 3, 2))),
    ("two cuts", lambda s, a, v: g.cuts(v, (1,))),
    ("at least one bin", lambda s, a, v: g.bins(v, 0.0, 1.0, 0)),
    ("with 4 bins", lambda s, a, v: g.clamp(g.bins(v[i], 0.0, 1.0, 4), 5)),
    ("no read", lambda s, a, v: v[g.drop(i)]),
    ("cannot be scanned", lambda s, a, v: g.scan(v[i], i, g.Welford)),
    ("beside another", lambda s, a, v: g.scan(g.fold(a[i, j], j), i)),
    ("along one index", lambda s, a, v: g.scan(v[i], 0)),
    ("order must name", lambda s, a, v: a[i, j].eval((i,))),
    ("no order", lambda s, a, v: as_expr(a).eval((i,))),
    ("fixed order", lambda s, a, v: g.scatter(g.clamp(v[i], 3), v[i]).eval((i,))),
    ("no elements", lambda s, a, v: g.scatter(g.clamp(v[i], 3), v[i])[0]),
    ("evaluate it first", lambda s, a, v: g.fold(v[i])[0]),
    ("values for", lambda s, a, v: g.literal(s, [1, 2, 3], (2, 2))),
    ("two values", lambda s, a, v: g.gen.choice(s, (2,), [1.0])),
    ("weights for", lambda s, a, v: g.gen.choice(s, (2,), [1.0, 2.0], [1.0])),
    ("beside an array", lambda s, a, v: g.evaluate(g.gen.uniform(s))),
    ("nothing to fold", lambda s, a, v: g.fold(as_expr(2.0))),
]


@pytest.mark.parametrize(("message", "build"), REJECTED, ids=[m for m, _ in REJECTED])
def test_rejected_when_built(spark, a, v, message, build):
    with pytest.raises((ShapeError, TypeError), match=message):
        build(spark, a, v)


@pytest.mark.parametrize("build", [lambda v: g.fold(v[i] > 0.0), lambda v: i * j, lambda v: g.clamp(v[i]) + 1, lambda v: bool(v[i] > 0.0)])
def test_type_errors(v, build):
    with pytest.raises(TypeError):
        build(v)


def test_heat_mode_decays(spark):
    n, r = 16, 0.25
    x = np.sin(2 * np.pi * np.arange(n) / n)
    f = g.literal(spark, x)
    for _ in range(3):
        f = ((1 - 2 * r) * f[i] + r * f[g.wrap(i - 1)] + r * f[g.wrap(i + 1)]).eval().materialize()
    rate = 1 - 2 * r * (1 - np.cos(2 * np.pi / n))
    assert np.allclose(f.numpy(), x * rate**3)


def test_streaming_scatter(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridframe.streaming.scatter import dense, scatter_stream

    spark.range(100).selectExpr("id % 5 as c", "cast(id as double) as x").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("c long, x double").parquet(str(tmp_path / "in"))
    q = scatter_stream(src, [(F.col("c"), 7, "drop")], F.col("x")).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    got = dense(spark.table("cells"), (7,)).numpy()
    assert got.tolist() == [sum(range(c, 100, 5)) for c in range(5)] + [0, 0]
