"""Arrays in closed form, and random ones that are a pure function of seed, stream and cell."""

from __future__ import annotations

import itertools
import math
import secrets
from collections.abc import Callable, Sequence


import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.expr import Elementwise, Expr, Generated, as_expr, call
from ..plans.frame import ShapeError


def fill(spark: SparkSession, shape: Sequence[int], value, dtype: str = "double") -> Generated:
    return Generated(spark, tuple(shape), lambda at: F.lit(value), dtype, "fill", (value,))


def iota(spark: SparkSession, shape: Sequence[int], start=0, dtype: str = "bigint") -> Generated:
    """start + position, row-major."""
    return Generated(spark, tuple(shape), lambda at: F.lit(start) + at, dtype, "iota", (start,))


def linspace(spark: SparkSession, n: int, a: float, b: float, dtype: str = "double") -> Generated:
    """n values from a to b, both ends exact; n = 1 gives a."""

    def make(at: Column) -> Column:
        t = at / F.lit(float(max(n - 1, 1)))
        return F.lit(float(a)) * (1 - t) + F.lit(float(b)) * t

    return Generated(spark, (n,), make, dtype, "linspace", (a, b))


# ---------------------------------------------------------------- Philox-4x32-10

# fixed values: the published multipliers and key increments of Philox-4x32
_MULTIPLY = (0xD2511F53, 0xCD9E8D57)
_BUMP = (0x9E3779B9, 0xBB67AE85)
ROUNDS = 10
_LOW = np.uint64(0xFFFFFFFF)


def philox(counter: Sequence[np.ndarray], key: Sequence[int]) -> list[np.ndarray]:
    """Four 32-bit words (as uint64 arrays) for each counter of four words."""
    c = [np.asarray(x, np.uint64) & _LOW for x in counter]
    k = [int(x) for x in key]
    for _ in range(ROUNDS):
        a, b = c[0] * np.uint64(_MULTIPLY[0]), c[2] * np.uint64(_MULTIPLY[1])
        c = [(b >> np.uint64(32)) ^ c[1] ^ np.uint64(k[0]), b & _LOW, (a >> np.uint64(32)) ^ c[3] ^ np.uint64(k[1]), a & _LOW]
        k = [(x + y) & 0xFFFFFFFF for x, y in zip(k, _BUMP, strict=True)]
    return c


def _mix64(x: int) -> int:
    """splitmix64: one step and its finaliser."""
    mask = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & mask
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return x ^ x >> 31


class _State:
    seed = secrets.randbits(64)
    streams = itertools.count()


def seed(s: int) -> None:
    """Set the seed and begin again with the first stream."""
    _State.seed, _State.streams = s & (1 << 64) - 1, itertools.count()


def _key() -> tuple[int, int]:
    k = _mix64(_State.seed ^ _mix64(next(_State.streams)))
    return k & 0xFFFFFFFF, k >> 32


def _words(cell: np.ndarray, draw: int, key: tuple[int, int]) -> list[np.ndarray]:
    cell = cell.astype(np.uint64)
    return philox([cell & _LOW, cell >> np.uint64(32), np.full(len(cell), draw, np.uint64), np.zeros(len(cell), np.uint64)], key)


def _unit(x: np.ndarray, y: np.ndarray, dtype: str = "double") -> np.ndarray:
    """[0, 1): 53 bits of two words, or 24 of one."""
    if dtype == "float":
        return (x >> np.uint64(8)).astype(float) * 2.0**-24
    return ((x << np.uint64(21)) ^ (y >> np.uint64(11))).astype(float) * 2.0**-53


def _drawn(spark, shape, name: str, of: Callable[[list[np.ndarray]], np.ndarray], dtype: str, params: tuple = ()) -> Generated:
    key = _key()
    @F.pandas_udf("double")
    def udf(at: pd.Series) -> pd.Series:
        return pd.Series(of(_words(at.to_numpy(), 0, key)))

    return Generated(spark, None if shape is None else tuple(shape), lambda at: udf(at), dtype, name, params)


def uniform(spark, shape=None, dtype: str = "double") -> Generated:
    """[0, 1). Without a shape: one draw for each cell of the expression it stands in."""
    return _drawn(spark, shape, "uniform", lambda w: _unit(w[0], w[1], dtype), dtype)


def _open_uniform(spark, shape, dtype: str) -> Generated:
    """(0, 1), for inverse transforms with a pole at either end."""
    bits = 24 if dtype == "float" else 53
    return _drawn(spark, shape, "uniform", lambda w: _unit(w[0], w[1], dtype) + 2.0 ** -(bits + 1), dtype)


def normal(spark, shape=None, dtype: str = "double") -> Generated:
    """Standard normal by Box and Muller, one output for each cell."""

    def of(w):
        u, v = _unit(w[0], w[1], dtype), _unit(w[2], w[3], dtype)
        return np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * math.pi * v)

    return _drawn(spark, shape, "normal", of, dtype)


def _from(u: Expr, name: str, fn: Callable[..., Column], *args) -> Elementwise:
    return call(name, lambda c, *p: fn(c, *(x.cast("double") for x in p)), u, *args, dtype=u.dtype)


def exponential(spark, shape=None, rate=1.0, dtype: str = "double") -> Elementwise:
    return _from(uniform(spark, shape, dtype), "exponential", lambda u, r: -F.log1p(-u) / r, rate)


def rayleigh(spark, shape=None, sigma=1.0, dtype: str = "double") -> Elementwise:
    return _from(uniform(spark, shape, dtype), "rayleigh", lambda u, s: s * F.sqrt(-2 * F.log1p(-u)), sigma)


def weibull(spark, shape=None, scale=1.0, k=1.0, dtype: str = "double") -> Elementwise:
    return _from(uniform(spark, shape, dtype), "weibull", lambda u, a, b: a * F.pow(-F.log1p(-u), 1 / b), scale, k)


def pareto(spark, shape=None, low=1.0, alpha=1.0, dtype: str = "double") -> Elementwise:
    return _from(uniform(spark, shape, dtype), "pareto", lambda u, m, a: m * F.pow(1 - u, -1 / a), low, alpha)


def lognormal(spark, shape=None, mu=0.0, sigma=1.0, dtype: str = "double") -> Elementwise:
    return _from(normal(spark, shape, dtype), "lognormal", lambda z, m, s: F.exp(m + s * z), mu, sigma)


def cauchy(spark, shape=None, x0=0.0, gamma=1.0, dtype: str = "double") -> Elementwise:
    return _from(_open_uniform(spark, shape, dtype), "cauchy", lambda u, a, g: a + g * F.tan(math.pi * (u - 0.5)), x0, gamma)


def gumbel(spark, shape=None, mu=0.0, beta=1.0, dtype: str = "double") -> Elementwise:
    return _from(_open_uniform(spark, shape, dtype), "gumbel", lambda u, m, b: m - b * F.log(-F.log(u)), mu, beta)


def logistic(spark, shape=None, mu=0.0, s=1.0, dtype: str = "double") -> Elementwise:
    return _from(_open_uniform(spark, shape, dtype), "logistic", lambda u, m, b: m + b * F.log(u / (1 - u)), mu, s)


def laplace(spark, shape=None, mu=0.0, b=1.0, dtype: str = "double") -> Elementwise:
    """Difference of two exponentials, from two streams."""
    one, two = uniform(spark, shape, dtype), uniform(spark, shape, dtype)
    return call("laplace", lambda u, v, m, s: m + s * (F.log1p(-v) - F.log1p(-u)), one, two, mu, b, dtype=dtype)


def choice(spark, shape, values: Sequence[float], weights: Sequence[float] | None = None, dtype: str = "double") -> Elementwise:
    """One of some values, from one draw cut by cumulative weights."""
    if len(values) < 2:
        raise ShapeError("at least two values to choose from")
    if weights is not None and len(weights) != len(values):
        raise ShapeError(f"{len(weights)} weights for {len(values)} values")
    w = np.asarray(weights if weights is not None else np.ones(len(values)), float)
    edges = np.cumsum(w)[:-1] / w.sum()

    def pick(u: Column) -> Column:
        out = F.lit(float(values[-1]))
        for v, e in reversed(list(zip(values[:-1], edges, strict=True))):
            out = F.when(u < float(e), F.lit(float(v))).otherwise(out)
        return out

    return call("choice", pick, uniform(spark, shape, dtype), dtype=dtype)


class Stream:
    """A cell's own generator inside ``sample``: each call takes the next draw."""

    def __init__(self, cell: int, key: tuple[int, int]):
        self.cell, self.key, self.draw, self.left = np.array([cell]), key, 0, []

    def bits(self) -> int:
        if not self.left:
            self.left = [int(x[0]) for x in _words(self.cell, self.draw, self.key)]
            self.draw += 1
        return self.left.pop(0)

    def uniform(self) -> float:
        a, b = self.bits(), self.bits()
        return float(_unit(np.array([a], np.uint64), np.array([b], np.uint64))[0])

    def normal(self) -> float:
        u, v = self.uniform(), self.uniform()
        return math.sqrt(-2 * math.log1p(-u)) * math.cos(2 * math.pi * v)


def sample(spark, shape: Sequence[int], f: Callable, *args, dtype: str = "double") -> Elementwise:
    """A user's sampler ``f(stream, *args)`` for each cell; it may reject and draw again."""
    key = _key()

    @F.pandas_udf("double")
    def udf(at: pd.Series, *xs: pd.Series) -> pd.Series:
        return pd.Series([float(f(Stream(c, key), *row)) for c, *row in zip(at, *xs, strict=True)])

    cell = Generated(spark, tuple(shape), lambda at: at, "bigint", "cell")
    return call("sample", lambda c, *cs: udf(c, *cs).cast(dtype), cell, *map(as_expr, args), dtype=dtype)


