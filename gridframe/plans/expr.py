"""Lazy expressions over arrays: elementwise nodes, indexed reads, reductions, scans, scatters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import prod

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators.index import Affine, Grouping, Ix, Read
from ..operators.reductions import Add, Op
from .frame import NdFrame, ShapeError, flat_index

SYMBOL = {"add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%", "and_": "&", "or_": "|", "xor": "^", "shl": "<<", "shr": ">>", "eq": "==", "ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "land": "&&", "lor": "||"}
COMPARE = {"eq", "ne", "lt", "gt", "le", "ge"}


class Expr:
    """A node. ``shape`` is set for positional (plain) expressions; indexed ones have free ids instead."""

    dtype: str
    children: tuple[Expr, ...] = ()
    bins: int | None = None

    def _bin(self, op: str, other, swap: bool = False):
        other = as_expr(other)
        return binary(op, other, self) if swap else binary(op, self, other)

    __add__ = lambda s, o: s._bin("add", o)
    __radd__ = lambda s, o: s._bin("add", o, True)
    __sub__ = lambda s, o: s._bin("sub", o)
    __rsub__ = lambda s, o: s._bin("sub", o, True)
    __mul__ = lambda s, o: s._bin("mul", o)
    __rmul__ = lambda s, o: s._bin("mul", o, True)
    __truediv__ = lambda s, o: s._bin("div", o)
    __rtruediv__ = lambda s, o: s._bin("div", o, True)
    __mod__ = lambda s, o: s._bin("mod", o)
    __rmod__ = lambda s, o: s._bin("mod", o, True)
    __lshift__ = lambda s, o: s._bin("shl", o)
    __rshift__ = lambda s, o: s._bin("shr", o)
    __and__ = lambda s, o: s._bin("and_", o)
    __or__ = lambda s, o: s._bin("or_", o)
    __xor__ = lambda s, o: s._bin("xor", o)
    __lt__ = lambda s, o: s._bin("lt", o)
    __gt__ = lambda s, o: s._bin("gt", o)
    __le__ = lambda s, o: s._bin("le", o)
    __ge__ = lambda s, o: s._bin("ge", o)
    __eq__ = lambda s, o: s._bin("eq", o)
    __ne__ = lambda s, o: s._bin("ne", o)
    __hash__ = object.__hash__

    def logical_and(self, other):
        return self._bin("land", other)

    def logical_or(self, other):
        return self._bin("lor", other)

    def __neg__(self):
        return unary("neg", self)

    def __pos__(self):
        return unary("pos", self)

    def __invert__(self):
        return unary("inv", self)

    def logical_not(self):
        return unary("not", self)

    def __bool__(self):
        raise TypeError("an expression has no truth value before it is evaluated")

    def __getitem__(self, subscripts):
        return subscripted(self, subscripts)

    def eval(self, order: Sequence[Ix] | None = None) -> NdFrame:
        from .lower import evaluate

        return evaluate(self, order)

    def walk(self) -> Iterator[Expr]:
        """All nodes, parents first, left to right."""
        yield self
        for c in self.children:
            yield from c.walk()

    # filled in by nodes
    def free(self) -> dict[Ix, int | None]:
        """Free ids and extents (None: not pinned), by first appearance."""
        out: dict[Ix, int | None] = {}
        for c in self.children:
            merge_ids(out, c.free())
        return out

    @property
    def shape(self) -> tuple[int, ...] | None:
        shapes = [c.shape for c in self.children if c.shape is not None and c.shape != ()]
        return shapes[0] if shapes else (() if all(c.shape == () for c in self.children) else None)

    def structural(self) -> Expr | None:
        return next((x for x in self.walk() if isinstance(x, (Fold, Scan, Scatter))), None)


def merge_ids(out: dict, new: dict) -> None:
    for i, e in new.items():
        if i in out and out[i] is not None and e is not None and out[i] != e:
            raise ShapeError(f"index {i.name} has extent {out[i]} and {e}")
        out[i] = out.get(i) if out.get(i) is not None else e


class Scalar(Expr):
    shape = ()

    def __init__(self, value):
        self.value = value
        self.dtype = "boolean" if isinstance(value, bool) else "int" if isinstance(value, int) and -(2**31) <= value < 2**31 else "bigint" if isinstance(value, int) else "double"

    def free(self):
        return {}


class Leaf(Expr):
    """An array read positionally."""

    def __init__(self, frame: NdFrame):
        self.frame, self.dtype = frame, frame.dtype

    @property
    def shape(self):
        return self.frame.shape

    def free(self):
        return {}


class Generated(Expr):
    """Values in closed form of the row-major position: no rows of its own, so it joins with nothing."""

    def __init__(self, spark, shape: tuple[int, ...] | None, make: Callable[[Column], Column], dtype: str, name: str, params: tuple = ()):
        self.spark, self._shape, self.make, self.dtype, self.name, self.params = spark, shape, make, dtype, name, params

    @property
    def shape(self):
        return self._shape if self._shape is not None else ()

    def free(self):
        return {}


class Indexed(Expr):
    """An array read at subscripts: indexes, affine forms, decorated or gathered coordinates, constants."""

    shape = None

    def __init__(self, base: Leaf | Generated, subs: tuple):
        self.base, self.subs, self.dtype = base, subs, base.dtype

    @property
    def children(self):
        return tuple(s.base for s in self.subs if isinstance(s, Read) and isinstance(s.base, Expr))

    def bare(self) -> bool:
        return all(isinstance(s, Ix) for s in self.subs) and len(set(self.subs)) == len(self.subs)

    def free(self):
        out: dict[Ix, int | None] = {}
        for s, e in zip(self.subs, self.base.shape, strict=True):
            if isinstance(s, Ix):
                merge_ids(out, {s: e})
            elif isinstance(s, Affine) or isinstance(s, Read) and isinstance(s.base, Affine):
                form = s if isinstance(s, Affine) else s.base
                for i, k in form.terms:
                    # a unit coefficient pins softly: a bare occurrence elsewhere overrides it
                    merge_ids(out, {i: out.get(i)})
            elif isinstance(s, Read):
                merge_ids(out, s.base.free())
        return out

    def soft(self) -> dict[Ix, int]:
        """Extents that single indexes with unit coefficient suggest."""
        out: dict[Ix, int] = {}
        for s, e in zip(self.subs, self.base.shape, strict=True):
            form = s if isinstance(s, Affine) else s.base if isinstance(s, Read) and isinstance(s.base, Affine) else None
            if form is not None:
                for i, k in form.terms:
                    if k == 1:
                        out.setdefault(i, e)
        return out


class IndexValue(Expr):
    """The index itself as a value."""

    shape, dtype = None, "bigint"

    def __init__(self, ix: Ix):
        self.ix = ix

    def free(self):
        return {self.ix: None}


class Elementwise(Expr):
    def __init__(self, op: str, children: tuple[Expr, ...], dtype: str, fn: Callable[..., Column] | None = None, extra: tuple = ()):
        self.op, self.children, self.dtype, self.fn, self.extra = op, tuple(children), dtype, fn, extra
        check_mix(self.children)

    def column(self, args: Sequence[Column]) -> Column:
        return self.fn(*args) if self.fn else _COLUMNS[self.op](self, *args)


class Fold(Expr):
    def __init__(self, op: Op, ids: tuple[Ix, ...] | None, axes: tuple[int, ...] | None, child: Expr):
        self.op, self.ids, self.axes, self.children = op, ids, axes, (child,)
        self.dtype = op.result(child.dtype)

    @property
    def shape(self):
        child = self.children[0].shape
        if self.ids is not None or child is None:
            return None if self.free() else ()
        return tuple(e for n, e in enumerate(child) if self.axes is not None and n not in self.axes)

    def free(self):
        return {} if self.ids is None else {i: e for i, e in self.children[0].free().items() if i not in self.ids}


class Scan(Expr):
    def __init__(self, op: Op, ix: Ix, child: Expr):
        self.op, self.ix, self.children, self.dtype = op, ix, (child,), op.result(child.dtype)

    shape = None


class Scatter(Expr):
    def __init__(self, op: Op, ids: tuple[Ix, ...], dests: tuple[Read, ...], child: Expr):
        self.op, self.ids, self.dests, self.dtype = op, ids, dests, op.result(child.dtype)
        self.children = (child, *(d.base for d in dests if isinstance(d.base, Expr)))
        self.child = child

    @property
    def shape(self):
        return None if self.free() else tuple(d.extent for d in self.dests)

    def free(self):
        out: dict[Ix, int | None] = {}
        for c in self.children:
            merge_ids(out, c.free())
        return {i: e for i, e in out.items() if i not in self.ids}


# ---------------------------------------------------------------- building


def as_expr(x) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, NdFrame):
        return Leaf(x)
    if isinstance(x, Ix):
        return IndexValue(x)
    if isinstance(x, (bool, int, float)):
        return Scalar(x)
    raise TypeError(f"{type(x).__name__} is no operand of an array expression")


def check_mix(children: Sequence[Expr]) -> None:
    """The rules that an operator's operands must meet."""
    plain = [c for c in children if c.shape not in (None, ())]
    indexed = [c for c in children if c.shape is None]
    if plain and indexed and not any(isinstance(x, Generated) and x._shape is None for x in plain):
        raise ShapeError("a positional array cannot be combined with an indexed one: subscript it")
    shapes = {c.shape for c in plain}
    if len(shapes) > 1:
        raise ShapeError(f"shapes differ: {sorted(shapes)}")
    ids: dict[Ix, int | None] = {}
    for c in children:
        merge_ids(ids, c.free())
    found = [c for c in children if c.structural() is not None]
    if len(found) > 1:
        raise ShapeError("one fold, scan or scatter in an expression: evaluate the other first")


def unary(op: str, a: Expr) -> Expr:
    dtype = {"neg": N.promote(a.dtype), "pos": N.promote(a.dtype), "inv": N.promote(a.dtype), "not": "boolean"}[op]
    if op == "inv" and N.is_float(a.dtype):
        raise TypeError("~ of a floating value")
    return Elementwise(op, (a,), dtype)


def binary(op: str, a: Expr, b: Expr) -> Expr:
    # a plain number takes the array's floating type, as a literal of that type would
    if isinstance(b, Scalar) and b.dtype == "double" and a.dtype == "float" and not isinstance(a, Scalar):
        common = "float"
    elif isinstance(a, Scalar) and a.dtype == "double" and b.dtype == "float" and not isinstance(b, Scalar):
        common = "float"
    else:
        common = N.promote(a.dtype, b.dtype)
    if op in COMPARE or op in ("land", "lor"):
        return Elementwise(op, (a, b), "boolean", extra=(common,))
    if op in ("and_", "or_", "xor", "shl", "shr") and N.is_float(common):
        raise TypeError(f"{SYMBOL[op]} of floating values")
    if op in ("shl", "shr"):
        common = N.promote(a.dtype)
    return Elementwise(op, (a, b), common)


def _arith(f):
    def column(node: Elementwise, a: Column, b: Column) -> Column:
        if N.is_float(node.dtype):
            return f(a.cast("double"), b.cast("double")).cast(node.dtype)
        return N.wrapped(f(a.cast("bigint"), b.cast("bigint")), node.dtype)

    return column


def _truth(c: Column, dtype: str) -> Column:
    return c if dtype == "boolean" else c.cast("double") != 0


_COLUMNS: dict[str, Callable[..., Column]] = {
    "add": _arith(lambda a, b: a + b),
    "sub": _arith(lambda a, b: a - b),
    "mul": _arith(lambda a, b: a * b),
    "div": lambda n, a, b: N.divide(a.cast(n.dtype), b.cast(n.dtype), n.dtype),
    "mod": lambda n, a, b: N.remainder(a.cast(n.dtype), b.cast(n.dtype), n.dtype),
    "and_": lambda n, a, b: a.cast(n.dtype).bitwiseAND(b.cast(n.dtype)),
    "or_": lambda n, a, b: a.cast(n.dtype).bitwiseOR(b.cast(n.dtype)),
    "xor": lambda n, a, b: a.cast(n.dtype).bitwiseXOR(b.cast(n.dtype)),
    "shl": lambda n, a, b: F.call_function("shiftleft", a.cast(n.dtype), b.cast("int")),
    "shr": lambda n, a, b: F.call_function("shiftright", a.cast(n.dtype), b.cast("int")),
    "land": lambda n, a, b: _truth(a, n.children[0].dtype) & _truth(b, n.children[1].dtype),
    "lor": lambda n, a, b: _truth(a, n.children[0].dtype) | _truth(b, n.children[1].dtype),
    "neg": lambda n, a: (-a.cast("double")).cast(n.dtype) if N.is_float(n.dtype) else N.wrapped(-a.cast("bigint"), n.dtype),
    "pos": lambda n, a: a.cast(n.dtype),
    "inv": lambda n, a: F.bitwise_not(a.cast(n.dtype)),
    "not": lambda n, a: ~_truth(a, n.children[0].dtype),
    "cuts": lambda n, x: sum(F.coalesce((N.compare(x, F.lit(e), ">=", n.children[0].dtype)).cast("int"), F.lit(0)) for e in n.extra) - 1,
}
for _op in COMPARE:
    _COLUMNS[_op] = lambda n, a, b: N.compare(a.cast(n.extra[0]), b.cast(n.extra[0]), SYMBOL[n.op], n.extra[0])


def subscripted(base, subscripts) -> Expr:
    subs = subscripts if isinstance(subscripts, tuple) else (subscripts,)
    base = as_expr(base)
    if isinstance(base, (Fold, Scan)):
        raise ShapeError("a reduction is not subscripted: evaluate it first")
    if isinstance(base, Scatter):
        raise ShapeError("a scatter has no elements before it is evaluated")
    if isinstance(base, Elementwise):
        if base.shape is None:
            raise ShapeError("an indexed expression has no elements")
        return Elementwise(base.op, tuple(c if isinstance(c, Scalar) else subscripted(c, subs) for c in base.children), base.dtype, base.fn, base.extra)
    if isinstance(base, Scalar):
        return base
    if len(subs) != len(base.shape):
        raise ShapeError(f"{len(subs)} subscripts for {len(base.shape)} axes")
    out = []
    for s, e in zip(subs, base.shape, strict=True):
        if isinstance(s, bool) or isinstance(s, int) and not 0 <= s < e:
            raise ShapeError(f"constant subscript {s} outside 0..{e - 1}")
        if isinstance(s, Affine) and len(s.terms) == 1 and s.terms[0][1] == 1 and s.offset == 0:
            s = s.terms[0][0]
        if isinstance(s, Affine) or isinstance(s, (Expr, NdFrame)):
            raise ShapeError("this subscript may leave the array: name a boundary (wrap, clamp, zero, pad)")
        if isinstance(s, Read):
            if any(st.policy == "drop" for st in s.stages):
                raise ShapeError("drop discards scattered rows and is no read")
            if isinstance(s.base, Expr) and s.base.dtype == "float" and e > 2**24:
                raise ShapeError(f"a float coordinate cannot tell {e} cells apart")
        out.append(s)
    if sum(any(st.policy == "pad" for st in s.stages) for s in out if isinstance(s, Read)) > 1 and len({s.fill for s in out if isinstance(s, Read) and any(st.policy == "pad" for st in s.stages)}) > 1:
        raise ShapeError("one pad value in a read")
    return Indexed(base, tuple(out))


def _open_read(e: Expr) -> bool:
    return any(isinstance(x, Indexed) and any(isinstance(s, Read) and any(t.policy == "zero" for t in s.stages) for s in x.subs) for x in e.walk())


def fold(e, *ids, op: Op = Add) -> Expr:
    """Reduce over indexes, axis numbers, or everything."""
    e = as_expr(e)
    if e.structural() is not None:
        raise ShapeError("a fold of a fold or scan: evaluate the inner one first")
    if e.shape == ():
        raise ShapeError("nothing to fold")
    if any(isinstance(i, Ix) for i in ids) and any(isinstance(i, int) for i in ids):
        raise ShapeError("indexes and axis numbers are not mixed")
    if len(set(ids)) != len(ids):
        raise ShapeError("an index or axis is folded twice")
    if e.shape is not None:
        if any(isinstance(i, Ix) for i in ids):
            raise ShapeError("a positional expression is folded by axis numbers")
        if any(not 0 <= i < len(e.shape) for i in ids):
            raise ShapeError(f"axes of {len(e.shape)} are 0..{len(e.shape) - 1}")
        axes = tuple(ids) or tuple(range(len(e.shape)))
        if op.positional and prod(e.shape[a] for a in axes) > 2**32:
            raise ShapeError("too many positions for an arg reduction")
        return Fold(op, None, axes, e)
    free = e.free()
    ids = tuple(ids) or tuple(free)
    pinned = extents(e)
    for i in ids:
        if i not in free:
            raise ShapeError(f"index {i.name} does not occur" if isinstance(i, Ix) else "an indexed expression is folded by indexes")
        if pinned.get(i) is None:
            raise ShapeError(f"the extent of index {i.name} is not known")
    if op is not Add and not op.structured and _open_read(e):
        raise ShapeError("a zero boundary inside this fold would take part as a value: only sums may skip it")
    return Fold(op, ids, None, e)


def extents(e: Expr) -> dict[Ix, int | None]:
    """Extents of the free ids: bare occurrences, else unit coefficients."""
    out = dict(e.free())
    soft: dict[Ix, int] = {}
    for x in e.walk():
        if isinstance(x, Indexed):
            for i, n in x.soft().items():
                soft.setdefault(i, n)
    return {i: n if n is not None else soft.get(i) for i, n in out.items()}


def scan(e, ix: Ix | int, op: Op = Add) -> Expr:
    """Inclusive running reduction along one index, or along an axis of a plain array by its number (negative: from the last)."""
    e = as_expr(e)
    if isinstance(ix, int) and not isinstance(ix, bool) and e.shape:
        from .lower import _positional

        if e.structural() is not None:
            raise ShapeError("a scan beside another reduction: evaluate that first")
        if not -len(e.shape) <= ix < len(e.shape):
            raise ShapeError(f"an array of {len(e.shape)} axes has no axis {ix}")
        ids = [Ix(f"axis{n}") for n in range(len(e.shape))]
        e, ix = _positional(e, ids), ids[ix]
    if not isinstance(ix, Ix):
        raise ShapeError("a scan runs along one index")
    if op.structured:
        raise ShapeError(f"{op.name} cannot be scanned")
    if e.structural() is not None:
        raise ShapeError("a scan beside another reduction: evaluate that first")
    if ix not in e.free():
        raise ShapeError(f"index {ix.name} does not occur")
    return Scan(op, ix, e)


def scatter(dests, value, *ids: Ix, op: Op = Add) -> Expr:
    """Reduce values into cells chosen by data or by the index; result axes: destinations, then ids not consumed."""
    dests = dests if isinstance(dests, tuple) else (dests,)
    value = as_expr(value)
    if not dests:
        raise ShapeError("at least one destination")
    for d in dests:
        if not isinstance(d, Read):
            raise ShapeError("a destination names its policy: wrap, clamp or drop")
        if d.stages[-1].policy not in ("wrap", "clamp", "drop") or len(d.stages) > 1:
            raise ShapeError("a destination has one of wrap, clamp, drop")
        if isinstance(d.base, Affine) and not (len(d.base.terms) == 1 and d.base.terms[0][1] == 1 and d.base.offset == 0):
            raise ShapeError("an affine form is no destination")
    parts = [value, *(d.base for d in dests if isinstance(d.base, Expr))]
    if any(p.structural() is not None for p in parts):
        raise ShapeError("a reduction inside a scatter: evaluate it first")
    whole: dict[Ix, int | None] = {}
    for p in parts:
        merge_ids(whole, extents(p))
    for d in dests:
        if isinstance(d.base, Affine):
            merge_ids(whole, {d.base.terms[0][0]: None})
        if isinstance(d.base, Grouping):
            merge_ids(whole, {d.base.ix: None})
    ids = ids or tuple(whole)
    for i in ids:
        if whole.get(i) is None:
            raise ShapeError(f"the extent of index {i.name} is not known")
    done = []
    for d in dests:
        base, extent = d.base, d.extent
        if isinstance(base, Affine):
            base = IndexValue(base.terms[0][0])
        if isinstance(base, Grouping):
            n = whole[base.ix]
            if base.count > n:
                raise ShapeError(f"{base.count} groups of {n} values")
            if base.edges is not None and (base.edges[0] != 0 or base.edges[-1] != n):
                raise ShapeError(f"cuts {base.edges} do not cover 0..{n}")
            group, ix = base, IndexValue(base.ix)
            if group.edges is None:
                base = Elementwise("bins", (ix,), "bigint", fn=lambda c, g=group, n=n: F.call_function("div", c * g.count, F.lit(n).cast("bigint")))
            else:
                base = Elementwise("cuts", (ix,), "int", extra=group.edges)
            extent = extent or group.count
        if extent is None:
            raise ShapeError("the extent of a destination is not known")
        done.append(Read(base, d.stages, d.fill, extent))
    return Scatter(op, tuple(ids), tuple(done), value)


def call(name: str, fn: Callable[..., Column], *args, dtype: str | Callable[..., str] = "double") -> Expr:
    """An elementwise node from a function of Columns; scalars broadcast."""
    children = tuple(as_expr(a) for a in args)
    kind = dtype(*(c.dtype for c in children)) if callable(dtype) else dtype
    return Elementwise(name, children, kind, fn=fn)


def map_by(fn: Callable, *args, dtype: str = "double") -> Expr:
    """A user's function of numpy arrays, in Arrow batches; ``call`` with Columns is faster where it can be written so."""
    @F.pandas_udf(dtype)
    def udf(*xs: pd.Series) -> pd.Series:
        return pd.Series(fn(*(x.to_numpy() for x in xs)))

    return call(getattr(fn, "__name__", "map"), lambda *cs: udf(*cs), *args, dtype=dtype)


# ---------------------------------------------------------------- looking at expressions


@dataclass(frozen=True)
class Slots:
    views: int
    scalars: int


def slots(e: Expr) -> Slots:
    """How many arrays and how many numbers an expression reads."""
    views = scalars = 0
    for x in e.walk():
        views += isinstance(x, Leaf) or isinstance(x, Indexed) and isinstance(x.base, Leaf)
        scalars += isinstance(x, Scalar)
        gen = x if isinstance(x, Generated) else x.base if isinstance(x, Indexed) and isinstance(x.base, Generated) else None
        scalars += len(gen.params) if gen is not None else 0
        scalars += sum(any(t.policy == "pad" for t in s.stages) for s in x.subs if isinstance(s, Read)) if isinstance(x, Indexed) else 0
    return Slots(views, scalars)


def leaves(e: Expr) -> Iterator[Expr]:
    """Leaves from left to right."""
    for x in e.walk():
        if isinstance(x, (Leaf, Scalar, Generated, Indexed, IndexValue)):
            yield x


def formula(e: Expr) -> str:
    """The expression as text: arrays in0, in1, ..., numbers s0, s1, ..."""
    count = {"in": 0, "s": 0, "g": 0}
    names: dict[str, str] = {}

    def fresh(kind: str) -> str:
        count[kind] += 1
        return f"{kind}{count[kind] - 1}"

    def index(i: Ix) -> str:
        return names.setdefault(i.name, f"i{len(names)}")

    def form(a: Affine) -> str:
        return "".join(("" if n == 0 and k > 0 else "+" if k > 0 else "-") + (f"{abs(k)}*" if abs(k) != 1 else "") + index(i) for n, (i, k) in enumerate(a.terms)) + (f"{a.offset:+d}" if a.offset else "")

    def read(s, extent: int) -> str:
        if isinstance(s, int):
            return str(s)
        if isinstance(s, Ix):
            return index(s)
        out = form(s.base) if isinstance(s.base, Affine) else text(s.base)
        for st in s.stages:
            out = f"{st.policy}{extent}({out})" + (f"{st.shift:+d}" if st.shift else "")
        return out

    def text(x: Expr) -> str:
        if isinstance(x, Scalar):
            return fresh("s")
        if isinstance(x, Leaf):
            return fresh("in")
        if isinstance(x, Generated):
            return f"{x.name}()"
        if isinstance(x, IndexValue):
            return index(x.ix)
        if isinstance(x, Indexed):
            head = fresh("in") if isinstance(x.base, Leaf) else f"{x.base.name}()"
            return f"{head}[{','.join(read(s, n) for s, n in zip(x.subs, x.base.shape, strict=True))}]"
        if isinstance(x, Fold):
            over = ",".join(index(i) for i in x.ids) if x.ids is not None else ",".join(map(str, x.axes))
            return f"{x.op.name}/{over}({text(x.children[0])})"
        if isinstance(x, Scan):
            return f"{x.op.name}\\{index(x.ix)}({text(x.children[0])})"
        if isinstance(x, Scatter):
            to = ",".join(read(d, d.extent) for d in x.dests)
            return f"{x.op.name}>{','.join(index(i) for i in x.ids)}[{to}]({text(x.child)})"
        args = [text(c) for c in x.children]
        if x.op in SYMBOL:
            return f"({args[0]} {SYMBOL[x.op]} {args[1]})"
        return {"neg": "-", "pos": "+", "inv": "~", "not": "!"}.get(x.op, x.op) + f"({', '.join(args)})"

    return text(e)


__all__ = ["Expr", "as_expr", "call", "extents", "flat_index", "fold", "formula", "leaves", "map_by", "scan", "scatter", "slots"]
