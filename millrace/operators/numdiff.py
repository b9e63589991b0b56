"""Numeric derivatives of Column expressions: f takes a list of Columns, grad gives a Column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import ColumnLike, real


def _check(f, x, h, method):
    if not callable(f):
        raise TypeError("f is a function of columns")
    if not isinstance(x, (list, tuple)) or not x:
        raise ValueError("x is a list of columns")
    if h <= 0:
        raise ValueError("h is positive")
    if method not in ("central", "forward"):
        raise ValueError("method is central or forward")


def _difference(f: Callable[[list[Column]], Column], x: list[Column], i: int, h: float, method: str) -> Column:
    def moved(by: float) -> list[Column]:
        return [c + F.lit(by) if j == i else c for j, c in enumerate(x)]

    if method == "central":
        return (f(moved(h)) - f(moved(-h))) / F.lit(2 * h)
    return (f(moved(h)) - f(x)) / F.lit(h)


def grad(f: Callable[[list[Column]], Column], x: Sequence[ColumnLike], h: float = 1e-5, method: str = "central") -> Column:
    """array of df/dx_i at every row; one projection."""
    _check(f, x, h, method)
    cols = [real(c) for c in x]
    return F.array(*(_difference(f, cols, i, h, method) for i in range(len(cols))))


def jacobian(f: Callable[[list[Column]], Column | list[Column]], x: Sequence[ColumnLike], h: float = 1e-5, method: str = "central") -> Column:
    """array of gradients, one for each output; a single output gives one row."""
    _check(f, x, h, method)
    cols = [real(c) for c in x]
    found = f(cols)
    if not isinstance(found, (list, tuple)):
        return F.array(grad(f, x, h, method))
    if any(isinstance(o, (list, tuple)) for o in found):
        raise ValueError("f returns one column or a flat list")
    return F.array(*(grad(lambda v, k=k: f(v)[k], x, h, method) for k in range(len(found))))
