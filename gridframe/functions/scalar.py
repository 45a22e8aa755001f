"""Scalar functions of arrays: JVM expressions where Spark has them, Arrow UDFs for special functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..plans.expr import call
from . import numerics as N


def _float(*dtypes: str) -> str:
    return "float" if all(d == "float" for d in dtypes) else "double"


def _same(*dtypes: str) -> str:
    return N.promote(*dtypes)


def _native(name, fn, result=_float):
    def build(*args):
        out = call(name, fn, *args, dtype=result)
        if out.dtype == "float":  # computed in double, narrowed once
            out.fn = lambda *cs: fn(*cs).cast("float")
        return out

    build.__name__ = name
    return build


def _d(fn):
    """Arguments as doubles."""
    return lambda *cs: fn(*(c.cast("double") for c in cs))


exp, expm1, sqrt, cbrt = (_native(n, _d(getattr(F, n))) for n in ("exp", "expm1", "sqrt", "cbrt"))
exp2 = _native("exp2", lambda c: F.pow(F.lit(2.0), c.cast("double")))
log, log2, log10 = (_native(n, (lambda f: lambda c: N.log(c, f))(getattr(F, n))) for n in ("log", "log2", "log10"))
log1p = _native("log1p", lambda c: F.when(c > -1, F.log1p(F.when(c > -1, c.cast("double")).otherwise(F.lit(0.0)))).when(c == -1, F.lit(float("-inf"))).otherwise(N.nan()))
pow = _native("pow", _d(F.pow))  # noqa: A001
hypot = _native("hypot", lambda a, b, *c: F.hypot(F.hypot(a.cast("double"), b.cast("double")), c[0].cast("double")) if c else F.hypot(a.cast("double"), b.cast("double")))
sin, cos, tan, asin, acos, atan, sinh, cosh, tanh, asinh, acosh, atanh = (_native(n, _d(getattr(F, n))) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh"))
atan2 = _native("atan2", _d(F.atan2))
floor = _native("floor", lambda c: N.whole(c, F.floor))
ceil = _native("ceil", lambda c: N.whole(c, F.ceil))
round = _native("round", lambda c: N.whole(c, lambda x: F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))))  # noqa: A001
trunc = _native("trunc", lambda c: N.whole(c, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))))
fmod = _native("fmod", lambda a, b: N.remainder(a.cast("double"), b.cast("double"), "double"))
abs = _native("abs", F.abs, _same)  # noqa: A001
fdim = _native("fdim", lambda a, b: F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), N.nan()).otherwise(F.greatest(a.cast("double") - b.cast("double"), F.lit(0.0))))
fmin = _native("fmin", _d(N.fmin))
fmax = _native("fmax", _d(N.fmax))
fma = _native("fma", lambda a, b, c: a.cast("double") * b.cast("double") + c.cast("double"))  # rounds twice


def _special(name: str):
    def build(*args):
        from . import special

        f = special.each(special.SCALAR[name])

        @F.pandas_udf("double")
        def udf(*xs: pd.Series) -> pd.Series:
            return pd.Series(f(*(x.to_numpy(dtype=float) for x in xs)))

        return call(name, lambda *cs: udf(*(c.cast("double") for c in cs)), *args, dtype=_float)

    build.__name__ = name
    return build


SPECIAL = (
    "erf", "erfc", "tgamma", "lgamma", "beta", "expint", "riemann_zeta", "cyl_bessel_j", "cyl_bessel_i", "cyl_bessel_k", "cyl_neumann", "sph_bessel", "sph_neumann", "legendre", "assoc_legendre", "sph_legendre",
    "hermite", "laguerre", "assoc_laguerre", "ellint_1", "ellint_2", "ellint_3", "comp_ellint_1", "comp_ellint_2", "comp_ellint_3", "remainder", "copysign",
)
globals().update({n: _special(n) for n in SPECIAL})


# complex numbers are structs of re and im
def complex_of(re, im):
    return call("complex", lambda a, b: F.struct(a.cast("double").alias("re"), b.cast("double").alias("im")), re, im, dtype="struct<re:double,im:double>")


_C = "struct<re:double,im:double>"


def _complex(name, fn, dtype=_C):
    def build(*args):
        return call(name, fn, *args, dtype=dtype)

    build.__name__ = name
    return build


def _pair(re, im):
    return F.struct(re.alias("re"), im.alias("im"))


real = _complex("real", lambda z: z["re"], "double")
imag = _complex("imag", lambda z: z["im"], "double")
arg = _complex("arg", lambda z: F.atan2(z["im"], z["re"]), "double")
norm = _complex("norm", lambda z: z["re"] * z["re"] + z["im"] * z["im"], "double")
cabs = _complex("cabs", lambda z: F.hypot(z["re"], z["im"]), "double")
conj = _complex("conj", lambda z: _pair(z["re"], -z["im"]))
proj = _complex("proj", lambda z: F.when((F.abs(z["re"]) == float("inf")) | (F.abs(z["im"]) == float("inf")), _pair(F.lit(float("inf")), F.when(z["im"] < 0, F.lit(-0.0)).otherwise(F.lit(0.0)))).otherwise(_pair(z["re"], z["im"])))
cadd = _complex("cadd", lambda a, b: _pair(a["re"] + b["re"], a["im"] + b["im"]))
csub = _complex("csub", lambda a, b: _pair(a["re"] - b["re"], a["im"] - b["im"]))
cmul = _complex("cmul", lambda a, b: _pair(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"]))
cdiv = _complex("cdiv", lambda a, b: _pair(N.divide(a["re"] * b["re"] + a["im"] * b["im"], b["re"] * b["re"] + b["im"] * b["im"], "double"), N.divide(a["im"] * b["re"] - a["re"] * b["im"], b["re"] * b["re"] + b["im"] * b["im"], "double")))
cexp = _complex("cexp", lambda z: _pair(F.exp(z["re"]) * F.cos(z["im"]), F.exp(z["re"]) * F.sin(z["im"])))
