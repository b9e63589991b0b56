"""Column expressions: missing-data policy, stable maths, vector distances, tree formulas.

NaN and NULL both mean "missing" in numeric input; `valid` maps both to NULL, which
Spark's aggregates skip.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = str | Column


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def real(c: ColumnLike) -> Column:
    return col(c).cast("double")


def valid(c: ColumnLike) -> Column:
    """The value as double, or NULL where it is NaN or NULL."""
    x = real(c)
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or `otherwise` where b is zero or missing."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def sigmoid(c: ColumnLike) -> Column:
    """1 / (1 + e^-x), computed on the side that cannot overflow; NaN stays NaN."""
    x = real(c)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def relu(c: ColumnLike) -> Column:
    x = real(c)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def logsumexp(arr: ColumnLike) -> Column:
    """ln of the sum of exponentials of an array's elements; all -inf gives -inf, empty gives NULL."""
    a = col(arr).cast("array<double>")
    top = F.array_max(a)
    return F.when(top == float("-inf"), top).otherwise(top + F.log(_total(F.transform(a, lambda x: F.exp(x - top)))))


def softmax(arr: ColumnLike) -> Column:
    """Exponentials of an array's elements over their sum; all -inf gives zeros."""
    a = col(arr).cast("array<double>")
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = _total(e)
    return F.when(top == float("-inf"), F.transform(a, lambda x: F.lit(0.0))).otherwise(F.transform(e, lambda x: x / total))


def logsumexp_over(c: ColumnLike, window) -> Column:
    """The same down the rows of a window's partition."""
    x = real(c)
    top = F.max(x).over(window)
    return F.when(top == float("-inf"), top).otherwise(top + F.log(F.sum(F.exp(x - top)).over(window)))


def softmax_over(c: ColumnLike, window) -> Column:
    x = real(c)
    top = F.max(x).over(window)
    e = F.exp(x - top)
    return F.when(top == float("-inf"), F.lit(0.0)).otherwise(e / F.sum(e).over(window))


def _pairwise(a: ColumnLike, b: ColumnLike, f) -> Column:
    x, y = col(a).cast("array<double>"), col(b).cast("array<double>")
    return F.when(F.size(x) == F.size(y), _total(F.zip_with(x, y, f))).otherwise(F.raise_error(F.lit("vectors differ in length")))


def squared_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return _pairwise(a, b, lambda x, y: (x - y) * (x - y))


def euclidean_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return _pairwise(a, b, lambda x, y: F.abs(x - y))


def cosine_similarity(a: ColumnLike, b: ColumnLike) -> Column:
    """Dot product over norms; zero where a norm is zero."""
    dot = _pairwise(a, b, lambda x, y: x * y)
    norms = F.sqrt(_pairwise(a, a, lambda x, y: x * y) * _pairwise(b, b, lambda x, y: x * y))
    return ratio(dot, norms)


def gini(counts: list[Column]) -> Column:
    """1 - sum of squared shares; 0 for no rows."""
    n = sum(counts[1:], counts[0]).cast("double")
    squares = [c * c for c in counts]
    return F.when(n > 0, 1 - sum(squares[1:], squares[0]) / (n * n)).otherwise(F.lit(0.0))


def gini_split(left: list[Column], right: list[Column]) -> Column:
    """Impurity of both sides, weighted by their rows."""
    nl, nr = sum(left[1:], left[0]), sum(right[1:], right[0])
    return ratio(nl * gini(left) + nr * gini(right), (nl + nr).cast("double"))


def hoeffding_bound(n: ColumnLike | int, delta: float, r: float = 1.0) -> Column:
    """sqrt(r^2 ln(1/delta) / 2n); r where there are no rows."""
    n = F.lit(n) if isinstance(n, int) else col(n)
    return F.when(n > 0, F.sqrt(F.lit(r * r * math.log(1 / delta)) / F.when(n > 0, 2 * n))).otherwise(F.lit(float(r)))
