"""Dense array analytics by index notation, on Spark DataFrames."""

from . import stats
from .functions import scalar as math
from .operators.index import Ix, bins, clamp, cuts, drop, pad, wrap, zero
from .operators.reductions import Add, And, ArgMax, ArgMin, BitAnd, BitOr, BitXor, Max, Min, MinMax, Mul, Or, Welford, user_op
from .plans.expr import call, fold, formula, leaves, map_by, scan, scatter, slots
from .plans.frame import NdFrame, ShapeError, fill_by, from_table, literal, rows_of
from .plans.lower import evaluate
from .sources import generators as gen
from .sources import npy

__all__ = [
    "Add", "And", "ArgMax", "ArgMin", "BitAnd", "BitOr", "BitXor", "Ix", "Max", "Min", "MinMax", "Mul", "NdFrame", "Or", "ShapeError", "Welford", "bins", "call", "clamp", "cuts", "drop", "evaluate", "fill_by",
    "fold", "formula", "from_table", "gen", "leaves", "literal", "map_by", "math", "npy", "pad", "rows_of", "scan", "scatter", "slots", "stats", "user_op", "wrap", "zero",
]
