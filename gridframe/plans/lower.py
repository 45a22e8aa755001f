"""From expressions to DataFrames: natural joins on ids, computed-key joins for reads, grouping for reductions, windows for scans.

One DataFrame per structural node, so Catalyst sees plain joins, aggregates and
windows.  Arrays of one source share its rows, and generated arrays are columns of
whatever rows there are, so neither costs a join.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators.index import Affine, Ix, Read
from ..operators.reductions import Add
from . import expr as E
from .frame import NdFrame, ShapeError, array_of, flat_index, grid

# greatest number of cells of an array that is sent to every executor for a lookup; larger ones are joined by a shuffle
BROADCAST_CELLS = 1 << 20
SCAN_BLOCK = 1 << 16

_names = itertools.count()


def _fresh(kind: str) -> str:
    return f"_{kind}{next(_names)}"


def session_of(e: E.Expr) -> SparkSession:
    for x in e.walk():
        if isinstance(x, E.Leaf):
            return x.frame.source.df.sparkSession
        if isinstance(x, E.Indexed) and isinstance(x.base, E.Leaf):
            return x.base.frame.source.df.sparkSession
        if isinstance(x, E.Generated):
            return x.spark
        if isinstance(x, E.Indexed) and isinstance(x.base, E.Generated):
            return x.base.spark
    return SparkSession.active()


def _positional(e: E.Expr, ids: Sequence[Ix]) -> E.Expr:
    """A plain expression as an indexed one, over the given ids."""
    if isinstance(e, E.Scalar) or e.shape is None:
        return e
    if isinstance(e, E.Generated) and e._shape is None:
        return e
    if isinstance(e, (E.Leaf, E.Generated)):
        return E.Indexed(e, tuple(ids)) if len(e.shape) else e
    if isinstance(e, E.Elementwise):
        return E.Elementwise(e.op, tuple(_positional(c, ids) for c in e.children), e.dtype, e.fn, e.extra)
    return e


class Rows:
    """Rows of an iteration space: a DataFrame with a column for each id, and Columns for the values read."""

    def __init__(self, spark: SparkSession, order: Sequence[Ix], extents: dict[Ix, int | None], absorbing: bool):
        self.spark, self.order, self.extents, self.absorbing = spark, list(order), extents, absorbing
        self.df: DataFrame | None = None
        self.have: dict[Ix, str] = {}
        self.values: dict[int, Column] = {}
        self.reads: dict[tuple, str] = {}

    def col(self, i: Ix) -> Column:
        return F.col(self.have[i])

    def need(self, i: Ix) -> None:
        """Make sure that there is a row for each value of the id."""
        if i in self.have:
            return
        if self.extents.get(i) is None:
            raise ShapeError(f"the extent of index {i.name} is not known")
        name = _fresh("i")
        axis = self.spark.range(self.extents[i]).select(F.col("id").alias(name))
        self.df = axis if self.df is None else self.df.crossJoin(F.broadcast(axis) if self.extents[i] <= BROADCAST_CELLS else axis)
        self.have[i] = name

    def join_rows(self, df: DataFrame, ids: Sequence[Ix], names: Sequence[str], size: int) -> None:
        """Natural join with rows that have each of the ids once."""
        shared = [(i, n) for i, n in zip(ids, names, strict=True) if i in self.have]
        if self.df is None:
            self.df = df
        else:
            for i, n in shared:
                df = df.withColumnRenamed(n, self.have[i])
            small = F.broadcast(df) if 0 <= size <= BROADCAST_CELLS else df
            self.df = self.df.join(small, [self.have[i] for i, _ in shared]) if shared else self.df.crossJoin(small)
        for i, n in zip(ids, names, strict=True):
            self.have.setdefault(i, n)


def _resolved(rows: Rows, s, extent: int, value_of) -> tuple[Column, Column]:
    """A subscript's cell, and whether it lies inside."""
    if isinstance(s, int):
        return F.lit(s).cast("bigint"), F.lit(True)
    if isinstance(s, Ix):
        return rows.col(s), F.lit(True)
    if isinstance(s.base, Affine):
        at = F.lit(s.base.offset).cast("bigint")
        for i, k in s.base.terms:
            at = at + rows.col(i) * k
    else:
        at = N.coordinate(value_of(s.base), s.base.dtype)
    ok = F.lit(True)
    for st in s.stages:
        if st.policy == "wrap":
            at = F.pmod(at, F.lit(extent).cast("bigint"))
        elif st.policy == "clamp":
            at = F.least(F.greatest(at, F.lit(0).cast("bigint")), F.lit(extent - 1).cast("bigint"))
        else:
            ok = ok & (at >= 0) & (at < extent)
        at = at + st.shift
    if s.stages[-1].shift:
        ok = ok & (at >= 0) & (at < extent)
    return at, ok


def _build(e: E.Expr, extents: dict[Ix, int | None], absorbing: bool = False, extra: Sequence[E.Expr] = ()) -> tuple[Rows, list[Column]]:
    """Rows of an indexed expression's space, and the Columns of it and of ``extra``."""
    parts = [e, *extra]
    order: dict[Ix, None] = {}
    for p in parts:
        order |= dict.fromkeys(p.free())
    rows = Rows(session_of(e), list(order), extents, absorbing)
    structural: dict[int, tuple[DataFrame, list[Ix], list[str], str]] = {}

    # structural nodes first: they bring the rows of their free ids
    def prepare(x: E.Expr) -> None:
        if isinstance(x, (E.Fold, E.Scan, E.Scatter)):
            if id(x) not in structural:
                structural[id(x)] = _structural(x)
            return
        for c in x.children:
            prepare(c)

    for p in parts:
        prepare(p)
    for df, ids, names, v in structural.values():
        rows.join_rows(df, ids, names, -1)
    for k, (_, _, _, v) in structural.items():
        rows.values[k] = F.col(v)

    def nodes(x: E.Expr):
        yield x
        if not isinstance(x, (E.Fold, E.Scan, E.Scatter)):
            for c in x.children:
                yield from nodes(c)

    found = [x for p in parts for x in nodes(p)]
    # arrays read at distinct bare ids: one natural join for each source and subscripts, the largest first
    bare = [x for x in found if isinstance(x, E.Indexed) and x.bare() and isinstance(x.base, E.Leaf)]
    groups: dict[tuple, list[E.Indexed]] = {}
    for x in bare:
        groups.setdefault((x.base.frame.source.uid, x.subs), []).append(x)
    keyless = [g for g in groups.values() if g[0].base.frame.source.keys is None]
    if keyless and len(groups) > 1:
        raise ShapeError("rows without coordinates combine only with arrays of the same rows")
    for (_, subs), xs in sorted(groups.items(), key=lambda g: -g[1][0].base.frame.size):
        source = xs[0].base.frame.source
        value = [(x, _fresh("v")) for x in xs]
        names = [_fresh("i") for _ in subs]
        keys = [F.col(k).cast("bigint").alias(n) for k, n in zip(source.keys or (), names, strict=False)]
        df = source.df.select(*keys, *(x.base.frame.value.alias(n) for x, n in value))
        if source.keys is None:
            rows.df = df
            rows.have |= dict.fromkeys(subs, "")
        else:
            rows.join_rows(df, subs, names, xs[0].base.frame.size)
        for x, n in value:
            rows.values[id(x)] = F.col(n)

    def value_of(x: E.Expr) -> Column:
        if id(x) in rows.values:
            return rows.values[id(x)]
        if isinstance(x, E.Scalar):
            out = F.lit(x.value).cast(x.dtype) if x.dtype != "double" else F.lit(float(x.value))
        elif isinstance(x, E.IndexValue):
            rows.need(x.ix)
            out = rows.col(x.ix)
        elif isinstance(x, E.Leaf):  # rank 0
            name = _fresh("v")
            one = F.broadcast(x.frame.source.df.select(x.frame.value.alias(name)))
            rows.df = one if rows.df is None else rows.df.crossJoin(one)
            out = F.col(name)
        elif isinstance(x, E.Generated):  # without a shape: by the position in the whole space
            for i in rows.order:
                rows.need(i)
            out = x.make(flat_index([rows.col(i) for i in rows.order], [extents[i] for i in rows.order])).cast(x.dtype)
        elif isinstance(x, E.Indexed):
            out = _read(rows, x, value_of)
        else:
            out = x.column([value_of(c) for c in x.children])
        rows.values[id(x)] = out
        return out

    out = [value_of(p) for p in parts]
    for i in rows.order:
        rows.need(i)
    return rows, out


def _read(rows: Rows, x: E.Indexed, value_of) -> Column:
    """A read that is no plain natural join: computed keys, boundaries, gathers, constants, diagonals, generated arrays."""
    for s in x.subs:
        if isinstance(s, Ix):
            rows.need(s)
        elif isinstance(s, Read) and isinstance(s.base, Affine):
            for i, _ in s.base.terms:
                rows.need(i)
    shape = x.base.shape
    at, inside = zip(*(_resolved(rows, s, n, value_of) for s, n in zip(x.subs, shape, strict=True)), strict=True)
    ok = inside[0]
    for o in inside[1:]:
        ok = ok & o
    open_read = any(isinstance(s, Read) and any(t.policy in ("zero", "pad") or t.shift for t in s.stages) for s in x.subs)
    fill = next((s.fill for s in x.subs if isinstance(s, Read) and any(t.policy == "pad" for t in s.stages)), 0)
    if isinstance(x.base, E.Generated):
        value = x.base.make(flat_index(at, shape)).cast(x.base.dtype)
        return F.when(ok, value).otherwise(F.lit(fill).cast(x.dtype)) if open_read else value
    source, value = x.base.frame.source, _fresh("v")
    if source.keys is None:
        raise ShapeError("rows without coordinates cannot be looked up")
    keys = [_fresh("k") for _ in shape]
    left = [_fresh("a") for _ in shape]
    table = source.df.select(*(F.col(k).cast("bigint").alias(n) for k, n in zip(source.keys, keys, strict=True)), x.base.frame.value.alias(value))
    for n, (s, k) in enumerate(zip(x.subs, keys, strict=True)):
        if isinstance(s, int):
            table = table.where(F.col(k) == s)  # reaches the scan
    if rows.df is None:
        rows.df = rows.spark.range(1).select()
    rows.df = rows.df.select("*", *(F.when(ok, a).alias(n) for a, n in zip(at, left, strict=True)))
    if x.base.frame.size <= BROADCAST_CELLS:
        table = F.broadcast(table)
    on = [F.col(a) == F.col(k) for a, k in zip(left, keys, strict=True)]
    # under a product in a plain sum, cells outside add nothing: an inner join leaves them out
    skip = open_read and rows.absorbing and fill == 0
    rows.df = rows.df.join(table, on, "inner" if skip or not open_read else "left").drop(*keys, *left)
    return F.coalesce(F.col(value), F.lit(fill).cast(x.dtype)) if open_read and not skip else F.col(value)


def _product_only(e: E.Expr) -> bool:
    """Whether a zero anywhere in the tree's reads makes the whole zero."""
    if isinstance(e, E.Elementwise):
        return e.op == "mul" and all(_product_only(c) for c in e.children)
    return isinstance(e, (E.Indexed, E.Scalar, E.IndexValue))


def _structural(x: E.Expr) -> tuple[DataFrame, list[Ix], list[str], str]:
    """(rows, ids, their columns, value column) of a fold, scan or scatter."""
    if isinstance(x, _Renamed):
        df, ids, names, v = _structural(x.node)
        return df, list(x.ids_out[: len(names)]), names, v
    if isinstance(x, E.Fold):
        return _fold(x)
    if isinstance(x, E.Scan):
        return _scan(x)
    return _scatter(x)


def _fold(x: E.Fold):
    child = x.children[0]
    axes = None
    if x.ids is None:
        axes = [Ix(f"#{n}") for n in range(len(child.shape))]
        child = _positional(child, axes)
        gone = [axes[a] for a in x.axes]
    else:
        gone = list(x.ids)
    extents = E.extents(child)
    rows, (v,) = _build(child, extents, absorbing=x.op is Add and _product_only(child))
    kept = [i for i in child.free() if i not in gone]
    at = flat_index([rows.col(i) for i in gone], [extents[i] for i in gone]) if x.op.positional else None
    name, names = _fresh("v"), [_fresh("i") for _ in kept]
    value = _fresh("x")
    df = rows.df.select(*(rows.col(i).alias(n) for i, n in zip(kept, names, strict=True)), v.alias(value), *([at.alias("_at")] if x.op.positional else []))
    df = df.groupBy(*names).agg(x.op.aggregate(F.col(value), child.dtype, F.col("_at") if x.op.positional else None).alias(name))
    if rows.absorbing and kept:
        # an inner join may have left groups without rows; they sum to zero
        df = _dense(df, names, [extents[i] for i in kept], name, x.op.identity(child.dtype), rows.spark)
    elif rows.absorbing:
        df = df.select(F.coalesce(F.col(name), x.op.identity(child.dtype)).alias(name))
    return df, kept, names, name


def _dense(df: DataFrame, names: Sequence[str], shape: Sequence[int], value: str, identity: Column, spark: SparkSession) -> DataFrame:
    """Every cell of the shape, the identity where there was none."""
    small = F.broadcast(df) if prod(shape) <= BROADCAST_CELLS else df
    return grid(spark, shape, names).join(small, list(names), "left").select(*names, F.when(F.col(value).isNull(), identity).otherwise(F.col(value)).alias(value))


def _scatter(x: E.Scatter):
    extents: dict[Ix, int | None] = {}
    parts = [x.child, *(d.base for d in x.dests)]
    for p in parts:
        for i, n in E.extents(p).items():
            extents[i] = extents.get(i) if extents.get(i) is not None else n
    rows, (v, *coords) = _build(x.child, extents, extra=[d.base for d in x.dests])
    kept = list(x.free())
    names = [_fresh("i") for _ in (*x.dests, *kept)]
    keys = []
    for d, c in zip(x.dests, coords, strict=True):
        at = N.coordinate(c, d.base.dtype)
        if d.stages[0].policy == "wrap":
            at = F.pmod(at, F.lit(d.extent).cast("bigint"))
        elif d.stages[0].policy == "clamp":
            at = F.least(F.greatest(at, F.lit(0).cast("bigint")), F.lit(d.extent - 1).cast("bigint"))
        keys.append(at)
    name, value = _fresh("v"), _fresh("x")
    at = flat_index([rows.col(i) for i in x.ids], [extents[i] for i in x.ids]) if x.op.positional else None
    df = rows.df.select(*(k.alias(n) for k, n in zip((*keys, *(rows.col(i) for i in kept)), names, strict=True)), v.alias(value), *([at.alias("_at")] if x.op.positional else []))
    for d, n in zip(x.dests, names, strict=False):
        if d.stages[0].policy == "drop":
            df = df.where((F.col(n) >= 0) & (F.col(n) < d.extent))
    df = df.groupBy(*names).agg(x.op.aggregate(F.col(value), x.child.dtype, F.col("_at") if x.op.positional else None).alias(name))
    shape = [d.extent for d in x.dests] + [extents[i] for i in kept]
    df = _dense(df, names, shape, name, x.op.identity(x.child.dtype), rows.spark)
    # destinations are axes of their own; as ids they get names that no placeholder has
    return df, [Ix(f"#{n}") for n in range(len(x.dests))] + kept, names, name


def _scan(x: E.Scan):
    child = x.children[0]
    extents = E.extents(child)
    rows, (v,) = _build(child, extents)
    ids = list(child.free())
    others = [i for i in ids if i != x.ix]
    names = {i: _fresh("i") for i in ids}
    value, name = _fresh("x"), _fresh("v")
    df = rows.df.select(*(rows.col(i).alias(n) for i, n in names.items()), v.alias(value))
    dtype = child.dtype
    running = lambda w: _windowed(x.op, F.col(value), dtype, w)
    to_here = lambda part: Window.partitionBy(*part).orderBy(names[x.ix]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = [names[i] for i in others]
    if extents[x.ix] <= SCAN_BLOCK or x.op.combine is None:
        df = df.withColumn(name, running(to_here(keys)))
        return df.select(*names.values(), name), ids, list(names.values()), name
    # long axes in two levels: within blocks, over the blocks' totals, then both combined; no task holds a whole axis
    df = df.withColumn("_block", F.call_function("div", F.col(names[x.ix]), F.lit(SCAN_BLOCK).cast("bigint")))
    within = df.withColumn(name, running(to_here([*keys, "_block"])))
    total = df.groupBy(*keys, "_block").agg(x.op.aggregate(F.col(value), dtype, None).alias(value))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("_before", _windowed(x.op, F.col(value), dtype, before)).select(*keys, "_block", "_before")
    blocks = extents[x.ix] // SCAN_BLOCK + 1
    small = F.broadcast(total) if blocks * prod(extents[i] for i in others) <= BROADCAST_CELLS else total
    both = within.join(small, [*keys, "_block"])
    both = both.withColumn(name, F.when(F.col("_before").isNull(), F.col(name)).otherwise(x.op.combine(F.col("_before"), F.col(name), dtype)))
    return both.select(*names.values(), name), ids, list(names.values()), name


def _windowed(op, v: Column, dtype: str, w) -> Column:
    """The running reduction; NULL before the first row of an empty frame."""
    if op.name == "+" and N.is_float(dtype):
        return F.sum(v.cast("double")).over(w).cast(dtype)
    if op.name == "+":
        return N.total(v, dtype, lambda c: c.over(w))
    plain = {"max": F.max, "min": F.min, "&": F.bit_and, "|": F.bit_or, "^": F.bit_xor, "&&": F.bool_and, "||": F.bool_or}
    if op.name in plain:
        if op.name in ("max", "min") and N.is_float(dtype):
            out = plain[op.name](F.when(~F.isnan(v), v)).over(w)
            return F.when(F.count(v).over(w) > 0, F.coalesce(out, op.identity(dtype)))
        return plain[op.name](v).over(w)
    if op.name == "*":
        return F.when(F.count(v).over(w) > 0, N.product(v, op.result(dtype), lambda c: c.over(w)))
    # a user's operator: reduce the list of what came before, which is quadratic in a block
    kind = op.result(dtype)
    return F.when(F.count(v).over(w) > 0, F.aggregate(F.collect_list(v.cast(kind)).over(w), op.identity(dtype).cast(kind), lambda a, b: op.combine(a, b, kind)))


def evaluate(e, order: Sequence[Ix] | None = None) -> NdFrame:
    """The array that an expression stands for, as a plan: nothing runs yet."""
    e = E.as_expr(e)
    if isinstance(e, E.Generated) and e._shape is None:
        raise ShapeError("a generator without a shape is evaluated beside an array only")
    node = e.structural()
    if order is not None and isinstance(node, E.Scatter):
        raise ShapeError("a scatter's axes have a fixed order")
    if e.shape is not None:
        if order is not None:
            raise ShapeError("a positional expression has no order of indexes")
        if node is None and all(isinstance(x, E.Generated) or isinstance(x, (E.Scalar, E.Elementwise)) for x in e.walk()) and not e.shape:
            rows = SparkSession.active().range(1)
            return array_of(rows.select(_scalar_column(e).alias("v")), (), e.dtype)
        ids = [Ix(f"#{n}") for n in range(len(e.shape))]
        shape, dtype = tuple(e.shape), e.dtype
        extents = dict(zip(ids, shape, strict=True))
        if node is not None:
            e = _replaced(e, node, ids)
        flat = _positional(e, ids)
        sources = {x.base.frame.source.uid: x.base.frame.source for x in flat.walk() if isinstance(x, E.Indexed) and isinstance(x.base, E.Leaf)}
        if len(sources) == 1 and node is None:
            # one source: the value is a column of its rows, under its own keys
            source = next(iter(sources.values()))
            rows, (v,) = _build(flat, extents)
            df = rows.df.select(*(rows.col(i).alias(f"d{n}") for n, i in enumerate(ids)), v.alias("v")) if source.keys else rows.df.select(v.alias("v"))
            return array_of(df, shape, dtype)
        rows, (v,) = _build(flat, extents)
        return array_of(rows.df.select(*(rows.col(i).alias(f"d{n}") for n, i in enumerate(ids)), v.alias("v")), shape, dtype)
    free = E.extents(e)
    ids = _axes(e)
    if order is not None:
        if set(order) != set(ids) or len(order) != len(ids):
            raise ShapeError(f"the order must name {', '.join(i.name for i in ids)} once each")
        ids = list(order)
    extents = dict(free)
    if isinstance(node, E.Scatter):
        for n, d in enumerate(node.dests):
            extents[Ix(f"#{n}")] = d.extent
    for i in ids:
        if extents.get(i) is None:
            raise ShapeError(f"the extent of index {i.name} is not known")
    rows, (v,) = _build(e, extents)
    return array_of(rows.df.select(*(rows.col(i).alias(f"d{n}") for n, i in enumerate(ids)), v.alias("v")), tuple(extents[i] for i in ids), e.dtype)


def _axes(e: E.Expr) -> list[Ix]:
    """Result axes: free ids by first appearance; a scatter's destinations come first."""
    node = e.structural()
    ids = list(e.free())
    return [Ix(f"#{n}") for n in range(len(node.dests))] + ids if isinstance(node, E.Scatter) else ids


def _replaced(e: E.Expr, node: E.Expr, ids: Sequence[Ix]) -> E.Expr:
    """A plain expression over a fold by axes or a scatter: the node's axes are renamed to the positions of its result."""
    if e is node:
        return _Renamed(node, ids)
    if isinstance(e, E.Elementwise):
        return E.Elementwise(e.op, tuple(_replaced(c, node, ids) for c in e.children), e.dtype, e.fn, e.extra)
    return e


class _Renamed(E.Fold):
    """A structural node whose result is read at given ids."""

    def __init__(self, node, ids):
        self.node, self.ids_out, self.dtype, self.children = node, ids, node.dtype, ()

    shape = None

    def free(self):
        shape = self.node.shape
        return dict(zip(self.ids_out, shape, strict=False)) if shape else {}


def _scalar_column(e: E.Expr) -> Column:
    return F.lit(e.value).cast(e.dtype) if isinstance(e, E.Scalar) else e.column([_scalar_column(c) for c in e.children])
