"""NumPy array files: one array each (.npy), or an archive by field name (.npz).

Writing streams the cells in order through the driver, so memory is bounded; reading
is distributed, each task seeking to its own slice of the file.
"""

from __future__ import annotations

import io
import os
import struct
import zipfile
from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.frame import NdFrame, array_of, unflatten

# Spark types and the file types they are written as; what a file holds and what it is read as
WRITES = {"boolean": "|b1", "tinyint": "|i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8", "struct<re:double,im:double>": "<c16"}
READS = {"|b1": "boolean", "|i1": "tinyint", "<i2": "smallint", "<i4": "int", "<i8": "bigint", "|u1": "smallint", "<u2": "int", "<u4": "bigint", "<u8": "decimal(20,0)", "<f2": "float", "<f4": "float", "<f8": "double", "<c8": "struct<re:double,im:double>", "<c16": "struct<re:double,im:double>"}
CHUNK = 1 << 18


class FileError(ValueError):
    """A file that is not what was asked for."""


def header(dtype: str, shape: tuple[int, ...]) -> bytes:
    """The exact first bytes of a version 1.0 file: padded to 64 bytes."""
    text = f"{{'descr': '{WRITES[dtype]}', 'fortran_order': False, 'shape': ({', '.join(map(str, shape))}{',' if len(shape) == 1 else ''}), }}"
    pad = -(len(text) + 11) % 64
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text) + pad + 1) + text.encode() + b" " * pad + b"\n"


def _body(a: NdFrame) -> Iterator[bytes]:
    if a.dtype not in WRITES:
        raise FileError(f"arrays of {a.dtype} have no file type")
    kind, buf = np.dtype(WRITES[a.dtype]), []
    for row in a.df.orderBy(a.flat()).select("v").toLocalIterator(prefetchPartitions=True):
        v = row[0]
        buf.append(complex(v.re, v.im) if isinstance(v, tuple) else v)
        if len(buf) == CHUNK:
            yield np.array(buf, kind).tobytes()
            buf = []
    if buf:
        yield np.array(buf, kind).tobytes()


def save(path: str, a: NdFrame) -> None:
    with open(path, "wb") as f:
        f.write(header(a.dtype, a.shape))
        for part in _body(a):
            f.write(part)


def _parse(f, name: str) -> tuple[str, tuple[int, ...], int]:
    magic = f.read(8)
    if magic[:6] != b"\x93NUMPY" or magic[6] != 1:
        raise FileError(f"{name}: not a version 1 array file")
    import ast

    n = struct.unpack("<H", f.read(2))[0]
    head = ast.literal_eval(f.read(n).decode("latin1"))
    if head["fortran_order"]:
        raise FileError(f"{name}: columns first is not supported")
    if head["descr"] not in READS:
        raise FileError(f"{name}: values of type {head['descr']} are not supported")
    return head["descr"], tuple(head["shape"]), 10 + n


def _check(name: str, descr: str, shape: tuple, dtype: str | None, want: tuple | None) -> None:
    if dtype is not None and READS[descr] != dtype:
        raise FileError(f"{name}: dtype is {descr}, not {dtype}")
    if want is not None and tuple(want) != shape:
        raise FileError(f"{name}: shape is {shape}, not {tuple(want)}")


def _column(values: np.ndarray) -> pa.Array:
    if values.dtype.kind == "c":
        return pa.StructArray.from_arrays([pa.array(values.real.astype(float)), pa.array(values.imag.astype(float))], ["re", "im"])
    if values.dtype.str == "<u8":
        return pa.array(values).cast(pa.decimal128(20, 0))
    kinds = {"|u1": np.int16, "<u2": np.int32, "<u4": np.int64, "<f2": np.float32}
    return pa.array(values.astype(kinds.get(values.dtype.str, values.dtype)))


def load(spark: SparkSession, path: str, dtype: str | None = None, shape: tuple[int, ...] | None = None) -> NdFrame:
    """The array of a file on a path that all executors see; a wrong type, shape or order is an error."""
    with open(path, "rb") as f:
        descr, found, at = _parse(f, os.path.basename(path))
    _check(os.path.basename(path), descr, found, dtype, shape)
    return _sliced(spark, path, at, descr, found)


def _sliced(spark: SparkSession, path: str, offset: int, descr: str, shape: tuple[int, ...]) -> NdFrame:
    size, width = prod(shape), np.dtype(descr).itemsize

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    a, b = k * CHUNK, min(size, (k + 1) * CHUNK)
                    f.seek(offset + a * width)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), _column(np.frombuffer(f.read((b - a) * width), descr))], ["at", "v"])

    kind = READS[descr]
    rows = spark.range(-(-size // CHUNK)).mapInArrow(read, f"at bigint, v {kind}")
    return array_of(rows.select(*(c.alias(f"d{n}") for n, c in enumerate(unflatten(F.col("at"), shape))), "v"), shape, kind)


def savez(path: str, arrays: dict[str, NdFrame]) -> None:
    """A stored archive, one member for each field."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=False) as z:
        for name, a in arrays.items():
            with z.open(f"{name}.npy", "w") as f:
                f.write(header(a.dtype, a.shape))
                for part in _body(a):
                    f.write(part)


def loadz(spark: SparkSession, path: str, fields: dict[str, tuple[str | None, tuple[int, ...] | None]]) -> dict[str, NdFrame]:
    """The named fields, each with the type and shape asked for (None: any); every one must be there."""
    out = {}
    with zipfile.ZipFile(path) as z:
        for name, (dtype, shape) in fields.items():
            try:
                info = z.getinfo(f"{name}.npy")
            except KeyError:
                raise FileError(f"no field {name} in {os.path.basename(path)}") from None
            if info.compress_type != zipfile.ZIP_STORED:
                raise FileError(f"{name}: compressed members are not supported")
            with z.open(info) as f:
                descr, found, at = _parse(f, name)
            _check(name, descr, found, dtype, shape)
            with open(path, "rb") as f:  # data begin after the member's own header, whose name and extra lengths it gives
                f.seek(info.header_offset + 26)
                a, b = struct.unpack("<HH", f.read(4))
            out[name] = _sliced(spark, path, info.header_offset + 30 + a + b + at, descr, found)
    return out


def to_bytes(a: NdFrame) -> bytes:
    """A whole file in memory, for small arrays."""
    f = io.BytesIO()
    f.write(header(a.dtype, a.shape))
    for part in _body(a):
        f.write(part)
    return f.getvalue()
