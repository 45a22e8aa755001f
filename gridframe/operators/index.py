"""Index notation: placeholders, affine forms, boundary policies, grouping coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from ..plans.frame import ShapeError


@dataclass(frozen=True)
class Ix:
    """An index placeholder, known by its name."""

    name: str

    def _form(self) -> Affine:
        return Affine(((self, 1),), 0)

    def __add__(self, other):
        return self._form() + other

    __radd__ = __add__

    def __sub__(self, other):
        return self._form() - other

    def __rsub__(self, other):
        return -1 * self._form() + other

    def __mul__(self, k):
        return self._form() * k

    __rmul__ = __mul__


@dataclass(frozen=True)
class Affine:
    """Sum of integer multiples of placeholders, plus an offset."""

    terms: tuple[tuple[Ix, int], ...]
    offset: int

    def __add__(self, other):
        if isinstance(other, int):
            return Affine(self.terms, self.offset + other)
        other = other._form() if isinstance(other, Ix) else other
        if not isinstance(other, Affine):
            raise TypeError("indexes add to indexes and integers only")
        total = dict(self.terms)
        for i, k in other.terms:
            total[i] = total.get(i, 0) + k
        return Affine(tuple((i, k) for i, k in total.items() if k), self.offset + other.offset)

    __radd__ = __add__

    def __mul__(self, k):
        if not isinstance(k, int):
            raise TypeError("an index may be multiplied by an integer only, not by another index")
        return Affine(tuple((i, c * k) for i, c in self.terms), self.offset * k)

    __rmul__ = __mul__

    def __sub__(self, other):
        return self + (-other if isinstance(other, int) else -1 * (other._form() if isinstance(other, Ix) else other))

    def __rsub__(self, other):
        return -1 * self + other


POLICIES = ("wrap", "clamp", "zero", "pad", "drop")


@dataclass(frozen=True)
class Stage:
    """One policy applied to a coordinate, then a displacement."""

    policy: str
    shift: int = 0


@dataclass(frozen=True)
class Read:
    """A decorated coordinate: an affine form or data, through up to four policies, innermost first."""

    base: object  # Affine or an expression
    stages: tuple[Stage, ...]
    fill: object = 0
    extent: int | None = None  # of a destination

    def __add__(self, k):
        if not isinstance(self.base, Affine):
            raise TypeError("no index arithmetic on a gathered coordinate")
        if not isinstance(k, int):
            raise TypeError("only integers may be added to a decorated index")
        return Read(self.base, (*self.stages[:-1], Stage(self.stages[-1].policy, self.stages[-1].shift + k)), self.fill, self.extent)

    def __sub__(self, k):
        return self + -k

    def __mul__(self, k):
        raise TypeError("a decorated index cannot be scaled")

    __rmul__ = __mul__


def _decorated(policy: str, x, extent: int | None = None, fill=0) -> Read:
    from ..plans.expr import Expr, as_expr

    if isinstance(x, Ix):
        x = x._form()
    if isinstance(x, Grouping):
        return Read(x, (Stage(policy),), fill, extent)
    if isinstance(x, Read):
        if len(x.stages) == 4:
            raise ShapeError("at most four boundary policies in a chain")
        if policy == "pad" and any(s.policy == "pad" for s in x.stages):
            raise ShapeError("one pad in a read")
        return Read(x.base, (*x.stages, Stage(policy)), fill if policy == "pad" else x.fill, extent or x.extent)
    ranged = extent
    if not isinstance(x, Affine):
        x = as_expr(x)
        if isinstance(x, Expr) and x.bins is not None:
            if extent is not None and extent != x.bins:
                raise ShapeError(f"extent {extent} of a coordinate with {x.bins} bins")
            ranged = x.bins
    return Read(x, (Stage(policy),), fill, ranged)


def wrap(x, extent: int | None = None) -> Read:
    """Periodic: the coordinate modulo the extent."""
    return _decorated("wrap", x, extent)


def clamp(x, extent: int | None = None) -> Read:
    """The nearest cell at the edge."""
    return _decorated("clamp", x, extent)


def zero(x) -> Read:
    """Reads 0 outside."""
    return _decorated("zero", x)


def pad(x, value) -> Read:
    """Reads a value outside."""
    return _decorated("pad", x, None, value)


def drop(x, extent: int | None = None) -> Read:
    """Scatters only: rows outside are left out."""
    return _decorated("drop", x, extent)


@dataclass(frozen=True)
class Grouping:
    """A coordinate made from the index itself: balanced bins or segments."""

    ix: Ix
    count: int
    edges: tuple[int, ...] | None = None
    uid: object = field(default=None, compare=False)


def bins(x, *args):
    """``bins(i, n)``: n balanced groups of an index.  ``bins(x, lo, hi, n)``: floor((x - lo) * (n / (hi - lo))), which may lie outside 0..n-1."""
    from ..functions import scalar as m
    from ..plans.expr import as_expr

    if isinstance(x, Ix):
        (n,) = args
        if n < 1:
            raise ShapeError("at least one bin")
        return Grouping(x, n)
    lo, hi, n = args
    if n < 1:
        raise ShapeError("at least one bin")
    if not all(isinstance(b, (int, float)) for b in (lo, hi)):
        raise ShapeError("bounds of bins are numbers")
    out = m.floor((as_expr(x) - float(lo)) * (n / (float(hi) - float(lo))))
    out.bins = n
    return out


def cuts(x, edges: Sequence):
    """How many edges are at or below x, minus one: left-closed cells; -1 below the first, k at or above the last."""
    from ..plans.expr import Elementwise, as_expr

    if len(edges) < 2:
        raise ShapeError("at least two cuts")
    if isinstance(x, Ix):
        if list(edges) != sorted(set(edges)):
            raise ShapeError("cuts of an index must increase")
        return Grouping(x, len(edges) - 1, tuple(edges))
    if not all(isinstance(e, (int, float)) for e in edges):
        raise ShapeError("cuts are numbers")
    out = Elementwise("cuts", (as_expr(x),), dtype="int", extra=tuple(edges))
    out.bins = len(edges) - 1
    return out
