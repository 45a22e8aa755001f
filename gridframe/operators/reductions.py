"""Reducing operators: plain, structured and the user's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numerics as N


@dataclass(frozen=True)
class Op:
    """``aggregate(value, dtype, at)`` makes the aggregate; ``identity(dtype)`` is the value of an empty cell.

    Structured operators need every cell, also those that a boundary fills, and cannot be scanned.
    """

    name: str
    aggregate: Callable[[Column, str, Column | None], Column]
    identity: Callable[[str], Column]
    result: Callable[[str], str]
    structured: bool = False
    positional: bool = False  # needs the position of each value
    combine: Callable[[Column, Column, str], Column] | None = None  # of two partial results


def _sum(v: Column, dtype: str, at=None) -> Column:
    if N.is_float(dtype):
        return F.sum(v.cast("double")).cast(dtype)
    return N.total(v, dtype)


def _finite(v: Column, dtype: str) -> Column:
    """NULL, which aggregates skip, in place of NaN."""
    return F.when(~F.isnan(v), v) if N.is_float(dtype) else v


def _keep(dtype: str) -> str:
    return dtype


def _bool(dtype: str) -> str:
    if dtype != "boolean":
        raise TypeError(f"and, or reduce truth values, not {dtype}")
    return dtype


def _number(dtype: str) -> str:
    if dtype == "boolean":
        raise TypeError("a sum of truth values would stay one: multiply by a number first")
    return dtype


def _whole(dtype: str) -> str:
    if dtype not in N.BITS:
        raise TypeError(f"bitwise operators reduce integers, not {dtype}")
    return dtype


def _floating(dtype: str) -> str:
    if not N.is_float(dtype):
        raise TypeError(f"mean and variance are of floating values, not {dtype}")
    return f"struct<mean:{dtype},var:{dtype}>"


def _lit(value, dtype: str) -> Column:
    return F.lit(value).cast(dtype)


def _minmax(v: Column, dtype: str, at=None) -> Column:
    x = _finite(v, dtype)
    lo, hi = (N.nan(), N.nan()) if N.is_float(dtype) else (_lit(N.HIGHEST[dtype], dtype), _lit(N.LOWEST[dtype], dtype))
    return F.struct(F.coalesce(F.min(x), lo).cast(dtype).alias("lo"), F.coalesce(F.max(x), hi).cast(dtype).alias("hi"))


def _welford(v: Column, dtype: str, at=None) -> Column:
    return F.struct(F.coalesce(F.avg(v.cast("double")), N.nan()).cast(dtype).alias("mean"), F.coalesce(F.var_samp(v.cast("double")), N.nan()).cast(dtype).alias("var"))


NOWHERE = 2**32 - 1


def _none_at(dtype: str) -> Column:
    return F.struct((N.nan() if N.is_float(dtype) else F.lit(0)).cast(dtype).alias("value"), F.lit(NOWHERE).cast("bigint").alias("at"))


def _argmax(v: Column, dtype: str, at: Column) -> Column:
    # the least position among equal values, whatever the order of rows
    best = F.max(F.when(~N.isnan(v, dtype), F.struct(v.alias("value"), (-at).alias("at"))))
    return F.when(best.isNull(), _none_at(dtype)).otherwise(F.struct(best["value"].alias("value"), (-best["at"]).alias("at")))


def _argmin(v: Column, dtype: str, at: Column) -> Column:
    best = F.min(F.when(~N.isnan(v, dtype), F.struct(v.alias("value"), at.alias("at"))))
    return F.when(best.isNull(), _none_at(dtype)).otherwise(best)


Add = Op("+", _sum, lambda d: _lit(0, d), _number, combine=N.add)
Mul = Op("*", lambda v, d, at=None: N.product(v, d), lambda d: _lit(1, d), _number, combine=N.times)
Max = Op("max", lambda v, d, at=None: F.coalesce(F.max(_finite(v, d)), _lit(N.LOWEST[d], d)), lambda d: _lit(N.LOWEST[d], d), _keep, combine=lambda a, b, d: F.greatest(a, b))
Min = Op("min", lambda v, d, at=None: F.coalesce(F.min(_finite(v, d)), _lit(N.HIGHEST[d], d)), lambda d: _lit(N.HIGHEST[d], d), _keep, combine=lambda a, b, d: F.least(a, b))
BitAnd = Op("&", lambda v, d, at=None: F.bit_and(v), lambda d: _lit(-1, d), _whole, combine=lambda a, b, d: a.bitwiseAND(b))
BitOr = Op("|", lambda v, d, at=None: F.bit_or(v), lambda d: _lit(0, d), _whole, combine=lambda a, b, d: a.bitwiseOR(b))
BitXor = Op("^", lambda v, d, at=None: F.bit_xor(v), lambda d: _lit(0, d), _whole, combine=lambda a, b, d: a.bitwiseXOR(b))
And = Op("&&", lambda v, d, at=None: F.bool_and(v), lambda d: F.lit(True), _bool, combine=lambda a, b, d: a & b)
Or = Op("||", lambda v, d, at=None: F.bool_or(v), lambda d: F.lit(False), _bool, combine=lambda a, b, d: a | b)
MinMax = Op("minmax", _minmax, lambda d: F.struct(*((N.nan() if N.is_float(d) else _lit(x, d)).cast(d).alias(n) for n, x in (("lo", N.HIGHEST[d]), ("hi", N.LOWEST[d])))), lambda d: f"struct<lo:{d},hi:{d}>", True)
Welford = Op("welford", _welford, lambda d: F.struct(N.nan().cast(d).alias("mean"), N.nan().cast(d).alias("var")), _floating, True)
ArgMax = Op("argmax", _argmax, _none_at, lambda d: f"struct<value:{d},at:bigint>", True, True)
ArgMin = Op("argmin", _argmin, _none_at, lambda d: f"struct<value:{d},at:bigint>", True, True)


def user_op(name: str, merge: Callable[[Column, Column], Column], identity, dtype: str = "double", lift: Callable[[Column], Column] | None = None, finish: Callable[[Column], Column] | None = None) -> Op:
    """A reducing operator from column expressions: ``merge`` must be associative and commutative, with ``identity``.

    A group's values meet in one array, so groups must fit in a task; the built-in operators have no such bound.
    """
    lift, finish = lift or (lambda c: c), finish or (lambda c: c)

    def aggregate(v: Column, d: str, at=None) -> Column:
        return F.aggregate(F.collect_list(lift(v).cast(dtype)), F.lit(identity).cast(dtype), lambda a, x: merge(a, x).cast(dtype), finish)

    return Op(name, aggregate, lambda d: finish(F.lit(identity).cast(dtype)), lambda d: dtype, combine=(lambda a, b, d: merge(a, b).cast(dtype)))
