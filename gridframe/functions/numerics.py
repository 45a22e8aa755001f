"""IEEE and C semantics as Spark columns: division, comparison, extrema, promotion.

Spark SQL raises on division by zero, ranks NaN above all numbers and turns
log(0) into NULL; arrays here follow IEEE instead and know no NULL.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# value types in order of C's usual conversions
RANK = {"boolean": 0, "tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 5, "double": 6}
LOWEST = {"tinyint": -(2**7), "smallint": -(2**15), "int": -(2**31), "bigint": -(2**63), "float": -3.4028234663852886e38, "double": -1.7976931348623157e308, "boolean": False}
HIGHEST = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1, "float": 3.4028234663852886e38, "double": 1.7976931348623157e308, "boolean": True}
BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def is_float(dtype: str) -> bool:
    return dtype in ("float", "double")


def promote(*dtypes: str) -> str:
    """Type of an arithmetic result: small integers and bool become int, the higher rank wins."""
    top = max(dtypes, key=RANK.__getitem__)
    return "int" if RANK[top] < RANK["int"] else top


def nan() -> Column:
    return F.lit(float("nan"))


def isnan(c: Column, dtype: str) -> Column:
    return F.isnan(c) if is_float(dtype) else F.lit(False)


def wrapped(c: Column, dtype: str) -> Column:
    """A bigint result brought back into a narrower integer, two's complement, without overflow errors."""
    if dtype == "bigint":
        return c
    n = BITS[dtype]
    half = 1 << (n - 1)
    return (F.pmod(c + F.lit(half).cast("bigint"), F.lit(1 << n).cast("bigint")) - half).cast(dtype)


def signed(c: Column) -> Column:
    """A whole decimal modulo 2 ** 64, as a bigint in two's complement."""
    low = F.pmod(c, F.lit(Decimal(1 << 64)))
    return F.when(low >= F.lit(Decimal(1 << 63)), low - F.lit(Decimal(1 << 64))).otherwise(low).cast("bigint")


def add(a: Column, b: Column, dtype: str) -> Column:
    """a + b, wrapped around for integers."""
    if is_float(dtype):
        return (a + b).cast(dtype)
    if dtype != "bigint":
        return wrapped(a.cast("bigint") + b.cast("bigint"), dtype)
    return signed(a.cast("decimal(20,0)") + b.cast("decimal(20,0)"))


def times(a: Column, b: Column, dtype: str) -> Column:
    """a * b, wrapped around for integers."""
    if is_float(dtype):
        return (a * b).cast(dtype)
    if dtype != "bigint":
        return wrapped(a.cast("bigint") * b.cast("bigint"), dtype)
    return signed((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)"))


def total(v: Column, dtype: str, over=lambda c: c) -> Column:
    """Sum of integers, wrapped around; the upper and lower halves of a bigint are added apart, so neither sum overflows
    below 2 ** 31 rows.  ``over`` places an aggregate in a window."""
    v = v.cast("bigint")
    if dtype != "bigint":
        return wrapped(over(F.sum(v)), dtype)
    mask = F.lit((1 << 32) - 1).cast("bigint")
    high, low = over(F.sum(F.shiftright(v, 32))), over(F.sum(v.bitwiseAND(mask)))
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(mask))


# An odd integer modulo 2 ** 64 is 5 to some power below 2 ** 62, negated or not.  So a product of integers is a sum of
# these powers, of the powers of two and of the signs: it combines within partitions like any sum, and wraps exactly.
_POWER = [pow(5, 1 << k, 1 << 64) for k in range(62)]
_INVERSE = [pow(p, -1, 1 << 64) for p in _POWER]


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("twos", "minus", "high", "low")]))
def _factors(v: pd.Series) -> pd.DataFrame:
    x = v.fillna(1).to_numpy(np.int64).view(np.uint64).copy()
    x[x == 0] = 1
    twos = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    x >>= twos
    # the shift was unsigned: bits above 64 - twos are lost, and the product has as many twos more
    minus = (x >> np.uint64(1)) & np.uint64(1)
    x = np.where(minus == 1, ~x + np.uint64(1), x)
    power = np.zeros(len(x), np.uint64)
    for k in range(62):
        on = (x >> np.uint64(k + 2)) & np.uint64(1) == 1
        x[on] *= np.uint64(_INVERSE[k])
        power[on] |= np.uint64(1 << k)
    return pd.DataFrame({"twos": twos.astype(np.int64), "minus": minus.astype(np.int64), "high": (power >> np.uint64(31)).astype(np.int64), "low": (power & np.uint64((1 << 31) - 1)).astype(np.int64)})


@F.pandas_udf(LongType())
def _multiplied(twos: pd.Series, minus: pd.Series, high: pd.Series, low: pd.Series) -> pd.Series:
    none = twos.isna().to_numpy()
    t, m, h, l = (x.fillna(0).to_numpy(np.int64).astype(np.uint64) for x in (twos, minus, high, low))
    power, x = (h << np.uint64(31)) + l, np.ones(len(t), np.uint64)
    for k in range(62):
        x[(power >> np.uint64(k)) & np.uint64(1) == 1] *= np.uint64(_POWER[k])
    x = np.where(m & np.uint64(1) == 1, ~x + np.uint64(1), x)
    x = np.where(t < 64, x << np.minimum(t, np.uint64(63)), np.uint64(0))
    return pd.Series(x.view(np.int64)).astype("Int64").mask(none)


def product(v: Column, dtype: str, over=lambda c: c) -> Column:
    """Product of numbers; of integers, wrapped around."""
    if is_float(dtype):
        return over(F.product(v.cast("double"))).cast(dtype)
    v = v.cast("bigint")
    f = _factors(v)
    parts = [over(F.sum(F.when(v.isNotNull() & (v != 0), f[c]))) for c in ("twos", "minus", "high", "low")]
    zero = over(F.max((v == 0).cast("int")))
    return F.when(zero == 1, F.lit(0).cast("bigint")).otherwise(_multiplied(*parts)) if dtype == "bigint" else wrapped(F.when(zero == 1, F.lit(0).cast("bigint")).otherwise(_multiplied(*parts)), dtype)


def divide(a: Column, b: Column, dtype: str) -> Column:
    """C division: integers truncate; floats give inf and NaN instead of errors."""
    if not is_float(dtype):
        return F.call_function("div", a.cast("bigint"), b.cast("bigint")).cast(dtype)
    a, b = a.cast("double"), b.cast("double")
    inf = F.when((a > 0) == (F.pow(b, F.lit(-1.0)) > 0), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b != 0, F.try_divide(a, b)).when(F.isnan(a) | (a == 0), nan()).when(F.isnan(b), b).otherwise(inf).cast(dtype)


def remainder(a: Column, b: Column, dtype: str) -> Column:
    """The sign of the dividend; x % 0.0 is NaN."""
    if not is_float(dtype):
        return (a % b).cast(dtype)
    return F.when(b == 0, nan()).otherwise(F.try_mod(a.cast("double"), b.cast("double"))).cast(dtype)


def compare(a: Column, b: Column, op: str, dtype: str) -> Column:
    """IEEE comparison: every one but != is false with a NaN."""
    plain = {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    if not is_float(dtype):
        return plain
    odd = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return plain | odd if op == "!=" else plain & ~odd


def fmax(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def fmin(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def log(c: Column, fn) -> Column:
    """-inf at 0 and NaN below it, where SQL has NULL."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (c < 0), nan()).when(c == 0, F.lit(float("-inf"))).otherwise(fn(F.when(c > 0, c).otherwise(F.lit(1.0))))


def whole(c: Column, fn) -> Column:
    """floor and the like, which saturate at bigint: large values, inf and NaN pass."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) >= F.lit(2.0**53)), c).otherwise(fn(F.when(F.abs(c) < F.lit(2.0**53), c).otherwise(F.lit(0.0))).cast("double"))


def coordinate(c: Column, dtype: str) -> Column:
    """An array coordinate from data: floats are floored and held within 1e9 either way; NaN goes to the low end."""
    if not is_float(dtype):
        return c.cast("bigint")
    c = c.cast("double")
    return F.when(F.isnan(c), F.lit(-1e9)).otherwise(F.floor(F.greatest(F.least(c, F.lit(1e9)), F.lit(-1e9)))).cast("bigint")
