"""Statistics of whole arrays and expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from .functions import numerics as N
from .operators.index import Ix, bins, clamp
from .operators.reductions import Add, ArgMax, MinMax, Welford
from .plans.expr import as_expr, fold, scatter
from .plans.frame import NdFrame, array_of, grid


def mean(e) -> NdFrame:
    """The arithmetic mean, in double also for integers."""
    e = as_expr(e)
    return fold(1.0 * e if not N.is_float(e.dtype) else e, op=Welford).eval().field("mean")


def mean_var(e) -> NdFrame:
    """Mean and sample variance in one pass, as a struct."""
    return fold(as_expr(e), op=Welford).eval()


def var(e) -> NdFrame:
    return mean_var(e).field("var")


def std(e) -> NdFrame:
    v = var(e)
    return v.with_value(F.sqrt(v.value), v.dtype)


@dataclass(frozen=True)
class Histogram:
    counts: NdFrame
    edges: NdFrame


def edges(spark, lo: float, hi: float, n: int) -> NdFrame:
    """n + 1 edges of equal bins."""
    df = grid(spark, (n + 1,))
    return array_of(df.select("d0", (F.lit(float(lo)) + F.col("d0") * F.lit((float(hi) - float(lo)) / n)).alias("v")), (n + 1,), "double")


def histogram(e, n: int = 64) -> Histogram:
    """Counts in n equal bins from least to greatest value; the greatest counts in the last bin, a constant array is widened by half a unit.

    Two passes: the ends come to the driver as two numbers, then the bins are counted with partial sums.
    """
    a = as_expr(e).eval()
    ends = fold(as_expr(a), op=MinMax).eval().item()
    lo, hi = float(ends["lo"]), float(ends["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    i = [Ix(f"h{k}") for k in range(a.rank)]
    one = (a[tuple(i)] == a[tuple(i)]).logical_or(True) * 1
    counts = scatter(clamp(bins(a[tuple(i)], lo, hi, n)), one, *i, op=Add).eval()
    return Histogram(counts, edges(a.source.df.sparkSession, lo, hi, n))


def mode(e, n: int = 64) -> NdFrame:
    """Centre of the fullest bin, the lowest on a tie."""
    h = histogram(e, n)
    best = fold(as_expr(h.counts), op=ArgMax).eval()
    at = best.df.select(F.col("v.at").alias("at"))
    e0, e1 = h.edges.df.select("d0", F.col("v").alias("a")), h.edges.df.select((F.col("d0") - 1).alias("d0"), F.col("v").alias("b"))
    df = F.broadcast(at).join(e0, F.col("at") == F.col("d0")).drop("d0").join(e1, F.col("at") == F.col("d0")).select(((F.col("a") + F.col("b")) / 2).alias("v"))
    return array_of(df, (), "double")
