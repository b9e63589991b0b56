"""NaN-skipping aggregates as Columns, usable with any groupBy, and the two that need a frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import ColumnLike, valid


INTERPOLATIONS = ("linear", "lower", "higher", "midpoint")


def mean(c: ColumnLike) -> Column:
    return F.avg(valid(c))


def median(c: ColumnLike) -> Column:
    return F.percentile(valid(c), 0.5)


def variance(c: ColumnLike, ddof: int = 0) -> Column:
    """Population variance by default; other ddof rescale it, NULL where too few rows remain."""
    if ddof == 0:
        return F.var_pop(valid(c))
    n = F.count(valid(c))
    return F.when(n > ddof, F.var_pop(valid(c)) * n / F.when(n > ddof, n - ddof))


def std(c: ColumnLike, ddof: int = 0) -> Column:
    return F.sqrt(variance(c, ddof))


def minimum(c: ColumnLike) -> Column:
    return F.min(valid(c))


def maximum(c: ColumnLike) -> Column:
    return F.max(valid(c))


def sum_of_squares(c: ColumnLike) -> Column:
    """Sum of x*x; NaN propagates."""
    x = F.col(c) if isinstance(c, str) else c
    return F.sum(x.cast("double") * x.cast("double"))


def check_fractions(q) -> list[float]:
    q = [q] if isinstance(q, (int, float)) else list(q)
    if not q or any(not 0 <= x <= 1 for x in q):
        raise ValueError("quantile fractions lie in [0, 1]")
    return [float(x) for x in q]


def quantile(df: DataFrame, c: str, q, interpolation: str = "linear", by: str | list[str] | None = None) -> DataFrame:
    """Rows (by..., q, value) from order statistics; linear within groups is one aggregate.

    Without groups, the order statistics are found by counting value ranges first and
    sorting only the ranges that hold one, so no task sees all rows.
    """
    q = check_fractions(q)
    if interpolation not in INTERPOLATIONS:
        raise ValueError(f"interpolation is one of {', '.join(INTERPOLATIONS)}")
    keys = [by] if isinstance(by, str) else list(by or [])
    if interpolation == "linear" and keys:
        out = df.groupBy(*keys).agg(F.percentile(valid(c), F.array(*map(F.lit, q))).alias("_v"))
        pairs = F.arrays_zip(F.array(*map(F.lit, q)).alias("q"), F.col("_v").alias("value"))
        return out.select(*keys, F.inline_outer(pairs)).toDF(*keys, "q", "value")
    picks = {"lower": ["floor"], "higher": ["ceil"]}.get(interpolation, ["floor", "ceil"])
    if keys:
        from pyspark.sql import Window

        rows = df.select(*keys, valid(c).alias("_x")).where("_x IS NOT NULL")
        w = Window.partitionBy(*keys)
        rows = rows.select(*keys, "_x", (F.row_number().over(w.orderBy("_x")) - 1).alias("_i"), F.count("_x").over(w).alias("_n"))
        frames = [
            rows.groupBy(*keys).agg(sum_over(picks, x).alias("value")).select(*keys, F.lit(x).alias("q"), "value") for x in q
        ]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
    rows = df.select(valid(c).alias("_x")).where("_x IS NOT NULL")
    n, at = rows.count(), {}
    wanted = sorted({getattr(math, p)((n - 1) * x) for p in picks for x in q}) if n else []
    if n:
        from ..operators.ordering import order_statistics

        at = order_statistics(rows, "_x", wanted)

    def value(x: float) -> float | None:
        if not n:
            return None
        ends, share = [at[getattr(math, p)((n - 1) * x)] for p in picks], (n - 1) * x % 1 if interpolation == "linear" else 0.5
        return ends[0] + (ends[-1] - ends[0]) * share

    values = [(x, value(x)) for x in q]
    return df.sparkSession.createDataFrame(values, "q double, value double")


def sum_over(picks: list[str], q: float) -> Column:
    """Mean of the order statistics that the picks name, inside a group with _i and _n."""
    parts = [F.max(F.when(F.col("_i") == getattr(F, p)((F.col("_n") - 1) * F.lit(q)), F.col("_x"))) for p in picks]
    return sum(parts[1:], parts[0]) / len(parts)


def percentile(df: DataFrame, c: str, q, interpolation: str = "linear", by=None) -> DataFrame:
    """The same with q in [0, 100]."""
    q = [q] if isinstance(q, (int, float)) else list(q)
    return quantile(df, c, [x / 100 for x in q], interpolation, by).withColumn("q", F.col("q") * 100)


def histogram(df: DataFrame, c: str, bins: int = 10, range: tuple[float, float] | None = None) -> DataFrame:
    """Rows (bin, lo, hi, n) for equal-width bins; the last is closed, empty ones appear.

    Without a range it spans the valid values; one value widens it by half on both sides,
    none gives zero counts on [0, 1].
    """
    if not isinstance(bins, int) or bins < 1:
        raise ValueError("bins is a positive integer")
    x = df.select(valid(c).alias("_x")).where("_x IS NOT NULL")
    if range is None:
        lo, hi = x.agg(F.min("_x"), F.max("_x")).first()
        lo, hi = (0.0, 1.0) if lo is None else (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    else:
        lo, hi = map(float, range)
        if not lo < hi:
            raise ValueError("range needs low < high")
    width = F.lit(hi) - F.lit(lo)
    bin_of = F.least(F.floor((F.col("_x") - lo) / width * bins), F.lit(bins - 1)).cast("long")
    counts = x.where((F.col("_x") >= lo) & (F.col("_x") <= hi)).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").alias("bin"), (F.lit(lo) + F.col("id") * width / bins).alias("lo"), (F.lit(lo) + (F.col("id") + 1) * width / bins).alias("hi"))
    return edges.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def across(columns: list[ColumnLike], how: str, ddof: int = 0) -> Column:
    """A reduction of several columns of one row (axis 1); missing values are left out, NULL where none is left."""
    ok = F.filter(F.array(*(valid(c) for c in columns)), lambda x: x.isNotNull())
    n = F.size(ok)
    total = F.aggregate(ok, F.lit(0.0), lambda a, x: a + x)
    if how in ("min", "max"):
        return F.array_min(ok) if how == "min" else F.array_max(ok)
    if how == "sum":
        return F.when(n > 0, total)
    if how == "mean":
        return F.when(n > 0, total / n)
    if how == "median":
        s = F.array_sort(ok)
        at = lambda i: F.get(s, i.cast("int"))
        return (at(F.floor((n - 1) / 2)) + at(F.ceil((n - 1) / 2))) / 2
    if how in ("var", "std"):
        squares = F.aggregate(ok, F.lit(0.0), lambda a, x: a + (x - total / n) * (x - total / n))
        spread = F.when(n > ddof, squares / F.when(n > ddof, n - ddof))
        return spread if how == "var" else F.sqrt(spread)
    raise ValueError("how is min, max, sum, mean, median, var or std")


def stacked(df: DataFrame, columns: list[str], out: str = "x") -> DataFrame:
    """All values of several columns as one (no axis), for any aggregate."""
    return df.select(F.explode(F.array(*(valid(c) for c in columns))).alias(out))


def distinct_sorted(c: ColumnLike) -> Column:
    """Sorted distinct values of a column of few categories."""
    return F.array_sort(F.collect_set(c))


