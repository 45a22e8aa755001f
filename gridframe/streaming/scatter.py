"""A scatter over a stream: running reductions of each cell of a fixed grid, as a streaming aggregation.

Cells without values appear only once the result is read with ``dense``; a stream
has no moment at which to fill them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators.reductions import Add, Op
from ..plans.frame import NdFrame, array_of, grid


def _placed(df: DataFrame, cells: Sequence[tuple[Column, int, str]]) -> DataFrame:
    for n, (c, extent, policy) in enumerate(cells):
        kind = df.select(c).schema[0].dataType.simpleString()
        at = N.coordinate(c, kind)
        if policy == "wrap":
            at = F.pmod(at, F.lit(extent).cast("bigint"))
        elif policy == "clamp":
            at = F.least(F.greatest(at, F.lit(0).cast("bigint")), F.lit(extent - 1).cast("bigint"))
        elif policy != "drop":
            raise ValueError("a destination has one of wrap, clamp, drop")
        df = df.withColumn(f"d{n}", at).where(F.col(f"d{n}").between(0, extent - 1))
    return df


def scatter_stream(df: DataFrame, cells: Sequence[tuple[Column, int, str]], value: Column, *, op: Op = Add, watermark: tuple[str, str] | None = None, window: tuple[str, str] | None = None) -> DataFrame:
    """Streaming rows (d0, d1, ..., v), one for each cell that has changed; with ``watermark`` and ``window`` (column, length) by tumbling windows.

    State is one partial result for each cell (and open window), never the rows.
    """
    if op.positional:
        raise ValueError("rows of a stream have no position")
    if watermark:
        df = df.withWatermark(*watermark)
    kind = df.select(value).schema[0].dataType.simpleString()
    rows = _placed(df.withColumn("_v", value), cells)
    keys = [f"d{n}" for n in range(len(cells))]
    groups = [F.window(*window).alias("window"), *keys] if window else keys
    return rows.groupBy(*groups).agg(op.aggregate(F.col("_v"), kind, None).alias("v"))


def dense(df: DataFrame, shape: Sequence[int], op: Op = Add, dtype: str = "double") -> NdFrame:
    """The array of a stream's table so far, empty cells filled with the operator's identity."""
    names = [f"d{n}" for n in range(len(shape))]
    full = grid(df.sparkSession, shape).join(df, names, "left").select(*names, F.when(F.col("v").isNull(), op.identity(dtype)).otherwise(F.col("v")).alias("v"))
    return array_of(full, shape, op.result(dtype))
