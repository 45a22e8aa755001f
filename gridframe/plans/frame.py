"""Dense arrays as DataFrames, and the checks that a table is one."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_serial = itertools.count()


class ShapeError(ValueError):
    """A rule of arrays is broken; raised when a node is built, before any job."""


@dataclass(frozen=True)
class Source:
    """A DataFrame that several arrays may take values from; arrays of one source never need a join."""

    df: DataFrame
    keys: tuple[str, ...] | None  # None: rows without coordinates
    uid: int = field(default_factory=lambda: next(_serial))


@dataclass(frozen=True)
class NdFrame:
    """A dense array: one row per cell, ``keys`` of the source as coordinates, ``value`` as its value.

    Not more than a description: nothing runs until a result is asked for.
    """

    source: Source
    value: Column
    shape: tuple[int, ...]
    dtype: str

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def df(self) -> DataFrame:
        """Coordinates d0, d1, ... and the value v."""
        return self.source.df.select(*(F.col(k).cast("bigint").alias(f"d{n}") for n, k in enumerate(self.source.keys or ())), self.value.alias("v"))

    def __getitem__(self, subscripts):
        from .expr import subscripted

        return subscripted(self, subscripts)

    def with_value(self, value: Column, dtype: str) -> NdFrame:
        """Another array of the same rows."""
        return NdFrame(self.source, value.cast(dtype) if dtype in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") else value, self.shape, dtype)

    def field(self, name: str) -> NdFrame:
        """One field of structured values."""
        kind = self.df.select(F.col(f"v.{name}")).schema[0].dataType.simpleString()
        return NdFrame(self.source, self.value[name], self.shape, kind)

    def at(self, *coords: int):
        """One element."""
        if len(coords) != self.rank or not all(0 <= c < e for c, e in zip(coords, self.shape, strict=True)):
            raise ShapeError(f"element {coords} of an array of shape {self.shape}")
        rows = self.df.where(F.lit(True) if not coords else sum((F.col(f"d{n}") == c).cast("int") for n, c in enumerate(coords)) == len(coords))
        return rows.first()["v"]

    def item(self):
        """The value of an array of rank 0."""
        if self.rank:
            raise ShapeError(f"an array of rank {self.rank} has no single value")
        return self.df.first()["v"]

    def flat(self) -> Column:
        """Row-major position, over the columns of ``df``."""
        return flat_index([F.col(f"d{n}") for n in range(self.rank)], self.shape)

    def numpy(self) -> np.ndarray:
        """The whole array in the driver's memory: for results known to be small."""
        rows = self.df.withColumn("_at", self.flat()).select("_at", "v").toPandas().sort_values("_at")
        return rows["v"].to_numpy().reshape(self.shape)

    def materialize(self) -> NdFrame:
        """Cut lineage by a checkpoint in the session's folder; for loops of evaluations."""
        spark = self.df.sparkSession
        if spark.sparkContext.getCheckpointDir() is None:
            folder = spark.conf.get("spark.checkpoint.dir", None)
            if not folder and spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(folder or "file:///tmp/checkpoints")
        return array_of(self.df.checkpoint(), self.shape, self.dtype)

    def to(self, order: Sequence[int]) -> NdFrame:
        """Axes in another order."""
        if sorted(order) != list(range(self.rank)):
            raise ShapeError(f"{tuple(order)} is no order of {self.rank} axes")
        df = self.df.select(*(F.col(f"d{o}").alias(f"d{n}") for n, o in enumerate(order)), "v")
        return array_of(df, tuple(self.shape[o] for o in order), self.dtype)


def _delegated(name: str):
    def method(self, *args):
        from .expr import as_expr

        return getattr(as_expr(self), name)(*args)

    return method


for _name in ("add", "radd", "sub", "rsub", "mul", "rmul", "truediv", "rtruediv", "mod", "rmod", "and", "or", "xor", "lshift", "rshift", "lt", "gt", "le", "ge", "neg", "pos", "invert"):
    setattr(NdFrame, f"__{_name}__", _delegated(f"__{_name}__"))


def flat_index(coords: Sequence[Column], shape: Sequence[int]) -> Column:
    out = F.lit(0).cast("bigint")
    for c, e in zip(coords, shape, strict=True):
        out = out * e + c
    return out


def unflatten(flat: Column, shape: Sequence[int]) -> list[Column]:
    """Coordinates of a row-major position."""
    out, rest = [], 1
    for e in reversed(shape):
        c = flat if rest == 1 else F.call_function("div", flat, F.lit(rest).cast("bigint"))
        out.append(F.pmod(c, F.lit(e).cast("bigint")))
        rest *= e
    return out[::-1]


def array_of(df: DataFrame, shape: Sequence[int], dtype: str) -> NdFrame:
    """An array over a DataFrame that already has d0, d1, ... and v."""
    return NdFrame(Source(df, tuple(f"d{n}" for n in range(len(shape)))), F.col("v"), tuple(shape), dtype)


def grid(spark: SparkSession, shape: Sequence[int], names: Sequence[str] | None = None) -> DataFrame:
    """One row for each cell of a shape."""
    names = names or [f"d{n}" for n in range(len(shape))]
    return spark.range(prod(shape)).select(*(c.alias(n) for n, c in zip(names, unflatten(F.col("id"), shape), strict=True)))


def from_table(df: DataFrame, dims: Sequence[str], value: str | Column, shape: Sequence[int] | None = None, *, check: bool = True, fill=None) -> NdFrame:
    """The array in a table's coordinate columns ``dims`` and a value.

    The table must hold each cell once.  That is checked by one aggregation without a
    shuffle: the count, the bounds and a sum of the positions' hashes against those
    of a range.  ``shape`` defaults to the greatest coordinates plus one.  With
    ``fill``, cells that the table lacks get that value instead of an error.
    """
    value = F.col(value) if isinstance(value, str) else value
    dims = tuple(dims)
    keyed = df.select(*(F.col(d).cast("bigint").alias(d) for d in dims), value.alias("v"))
    dtype = keyed.schema["v"].dataType.simpleString()
    hash_sum = lambda c: F.sum(F.xxhash64(c).cast("decimal(20,0)"))
    if shape is None or check:
        bounds = keyed.agg(F.count("*").alias("n"), *(f(F.col(d)).alias(f"{g}_{d}") for d in dims for f, g in ((F.min, "lo"), (F.max, "hi")))).first()
        shape = tuple(shape) if shape else tuple((bounds[f"hi_{d}"] if bounds[f"hi_{d}"] is not None else -1) + 1 for d in dims)
        low, high = [bounds[f"lo_{d}"] for d in dims], [bounds[f"hi_{d}"] for d in dims]
        if check and bounds["n"] and any(lo is None or lo < 0 or hi >= e for lo, hi, e in zip(low, high, shape, strict=True)):
            raise ShapeError(f"coordinates from {low} to {high} do not fit the shape {shape}")
        if check and fill is None:
            flat = flat_index([F.col(d) for d in dims], shape)
            if bounds["n"] != prod(shape) or keyed.agg(hash_sum(flat)).first()[0] != df.sparkSession.range(prod(shape)).agg(hash_sum(F.col("id"))).first()[0]:
                raise ShapeError(f"{bounds['n']} rows do not hold each of the {prod(shape)} cells of {shape} once")
    if fill is not None:
        full = grid(df.sparkSession, shape, dims).join(keyed, list(dims), "left").select(*dims, F.coalesce("v", F.lit(fill).cast(dtype)).alias("v"))
        return NdFrame(Source(full, dims), F.col("v"), tuple(shape), dtype)
    return NdFrame(Source(df, dims), value, tuple(shape), dtype)


def rows_of(df: DataFrame, value: str | Column) -> NdFrame:
    """Rows without coordinates, such as unordered particles: one axis that only a scatter or a whole fold may consume."""
    value = F.col(value) if isinstance(value, str) else value
    return NdFrame(Source(df, None), value, (-1,), df.select(value).schema[0].dataType.simpleString())


def literal(spark: SparkSession, values: Sequence, shape: Sequence[int] | None = None, dtype: str | None = None) -> NdFrame:
    """An array of given values, in row-major order; exactly as many as the shape has cells."""
    flat = np.asarray(values)
    shape = tuple(shape) if shape is not None else flat.shape
    flat = flat.ravel()
    if len(flat) != prod(shape):
        raise ShapeError(f"{len(flat)} values for the {prod(shape)} cells of {shape}")
    dtype = dtype or {"f": "float" if flat.dtype.itemsize == 4 else "double", "b": "boolean"}.get(flat.dtype.kind, "bigint" if flat.dtype.itemsize == 8 else "int")
    if dtype in ("float", "double"):
        flat = flat.astype(float)
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(flat.tolist())], f"at bigint, v {'double' if dtype in ('float', 'double') else dtype}")
    return array_of(rows.select(*(c.alias(f"d{n}") for n, c in enumerate(unflatten(F.col("at"), shape))), F.col("v").cast(dtype).alias("v")), shape, dtype)


def fill_by(spark: SparkSession, shape: Sequence[int], f, dtype: str = "double") -> NdFrame:
    """An array from a function of the coordinates: Columns in, a Column out."""
    df = grid(spark, shape)
    return NdFrame(Source(df, tuple(f"d{n}" for n in range(len(shape)))), f(*(F.col(f"d{n}") for n in range(len(shape)))).cast(dtype), tuple(shape), dtype)
