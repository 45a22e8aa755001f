"""Incremental scatters: the one array operation that makes sense on an unbounded input."""

from .scatter import scatter_stream

__all__ = ["scatter_stream"]
