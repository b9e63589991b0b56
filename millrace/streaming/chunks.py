"""Chunk statistics of stored streams: one aggregate by chunk, windows over the few chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, valid
from ..operators.metrics import counts, rates


def chunk_of(order: str, size: int) -> Column:
    return F.floor(F.col(order) / size).cast("long")


def chunk_stats(df: DataFrame, chunk: Column, value: str) -> DataFrame:
    x = valid(value)
    return df.groupBy(chunk.alias("chunk")).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.min(x).alias("low"), F.max(x).alias("high"))


def window_mean(stats: DataFrame, size: int) -> DataFrame:
    """Unweighted mean of the last `size` chunks' means (a row for each chunk, not for each value)."""
    w = Window.orderBy("chunk").rowsBetween(-(size - 1), 0)
    return stats.select("chunk", F.avg("mean").over(w).alias("window_mean"))


def cumulative(stats: DataFrame) -> DataFrame:
    """Count and mean over all chunks so far."""
    w = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("n").over(w)
    return stats.select("chunk", n.alias("n"), ratio(F.sum(F.col("mean") * F.col("n")).over(w), n).alias("mean"))


def rolling_metrics(df: DataFrame, chunk: Column, y_true: str, y_pred: str, size: int) -> DataFrame:
    """Each chunk's metrics averaged over the last `size` chunks, and the accuracy over all so far."""
    rows = df.select(chunk.alias("chunk"), valid(y_true).alias("y"), valid(y_pred).alias("p")).where("y IS NOT NULL AND p IS NOT NULL")
    per = rows.groupBy("chunk").agg(*(v.alias(k) for k, v in counts().items()))
    r = rates({k: F.col(k) for k in ("tn", "fp", "fn", "tp")})
    per = per.select("chunk", (F.col("tn") + F.col("tp")).alias("right"), (F.col("tn") + F.col("tp") + F.col("fp") + F.col("fn")).alias("n"), *(v.alias(k) for k, v in r.items()))
    w = Window.orderBy("chunk").rowsBetween(-(size - 1), 0)
    all_so_far = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("chunk", *(F.avg(k).over(w).alias(f"rolling_{k}") for k in ("accuracy", "precision", "recall", "f1")), (F.sum("right").over(all_so_far) / F.sum("n").over(all_so_far)).alias("cumulative_accuracy"))
