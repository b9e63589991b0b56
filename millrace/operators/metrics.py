"""Classification and regression metrics; pairs with a missing side are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, valid
from .ordering import _offset_column, buckets_of, with_bucket


def pairs(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """(y, p) of the rows where both are there."""
    return df.select(valid(y_true).alias("y"), valid(y_pred).alias("p")).where("y IS NOT NULL AND p IS NOT NULL")


def check_binary(df: DataFrame, *columns: str) -> None:
    """ValueError unless all values are 0 or 1."""
    bad = [F.coalesce(F.bool_or(~F.col(c).isin(0.0, 1.0)), F.lit(False)) for c in columns]
    if any(df.agg(*(b.alias(f"b{i}") for i, b in enumerate(bad))).first()):
        raise ValueError("labels are 0 or 1")


def counts() -> dict[str, Column]:
    """tn, fp, fn, tp over columns y and p, one pass."""
    def n(y: int, p: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("p") == p), 1).otherwise(0)), F.lit(0)).cast("long")

    return {"tn": n(0, 0), "fp": n(0, 1), "fn": n(1, 0), "tp": n(1, 1)}


def rates(c: dict[str, Column]) -> dict[str, Column]:
    """accuracy, precision, recall and f1 from the counts; 0/0 is 0."""
    tp, fp, fn, tn = (c[k].cast("double") for k in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)}


def classification_report(df: DataFrame, y_true: str, y_pred: str, by: list[str] | None = None, check: bool = True) -> DataFrame:
    """One row (for each group): tn, fp, fn, tp, accuracy, precision, recall, f1."""
    by = by or []
    rows = df.select(*by, valid(y_true).alias("y"), valid(y_pred).alias("p")).where("y IS NOT NULL AND p IS NOT NULL")
    if check:
        check_binary(rows, "y", "p")
    base = rows.groupBy(*by).agg(*(v.alias(k) for k, v in counts().items()))
    return base.select(*by, "tn", "fp", "fn", "tp", *(v.alias(k) for k, v in rates({k: F.col(k) for k in ("tn", "fp", "fn", "tp")}).items()))


def _one(df: DataFrame, y_true: str, y_pred: str, name: str) -> float:
    return classification_report(df, y_true, y_pred).first()[name]


def accuracy(df: DataFrame, y_true: str, y_pred: str) -> float:
    return _one(df, y_true, y_pred, "accuracy")


def precision(df: DataFrame, y_true: str, y_pred: str) -> float:
    return _one(df, y_true, y_pred, "precision")


def recall(df: DataFrame, y_true: str, y_pred: str) -> float:
    return _one(df, y_true, y_pred, "recall")


def f1(df: DataFrame, y_true: str, y_pred: str) -> float:
    return _one(df, y_true, y_pred, "f1")


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str) -> list[list[int]]:
    """[[tn, fp], [fn, tp]]."""
    r = classification_report(df, y_true, y_pred).first()
    return [[r["tn"], r["fp"]], [r["fn"], r["tp"]]]


def confusion_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """(y, p, n) for any number of classes."""
    return pairs(df, y_true, y_pred).groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))


def mse(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row: mean squared error, 0 without pairs."""
    return pairs(df, y_true, y_pred).agg(F.coalesce(F.avg(F.pow(F.col("y") - F.col("p"), 2)), F.lit(0.0)).alias("mse"))


def roc_curve(df: DataFrame, y_true: str, score: str, row_id: str, collapse_ties: bool = False) -> DataFrame:
    """(position, threshold, fpr, tpr): a point for each row by falling score, ties by row id.

    Running sums are taken inside ranges of the score and offset by the ranges' totals.
    """
    rows = df.select(F.col(row_id).alias("_id"), F.col(y_true).cast("double").alias("y"), F.col(score).cast("double").alias("s"))
    check_binary(rows, "y")
    rows = rows.withColumn("_x", -F.col("s"))
    rows = rows.withColumn("_b", with_bucket("_x", buckets_of(rows, "_x")))
    per = sorted((r["_b"], r["n"], int(r["p"] or 0)) for r in rows.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect())
    n = p = 0
    at_n, at_p = {}, {}
    for b, bn, bp in per:
        at_n[b], at_p[b] = n, p
        n, p = n + bn, p + bp
    if p == 0 or p == n:
        raise ValueError("both classes are needed")
    w = Window.partitionBy("_b").orderBy("_x", "_id").rowsBetween(Window.unboundedPreceding, 0)
    tp = F.sum("y").over(w) + _offset_column(at_p)
    i = F.row_number().over(Window.partitionBy("_b").orderBy("_x", "_id")) + _offset_column(at_n)
    out = rows.select(i.alias("position"), F.col("s").alias("threshold"), ((i - tp) / (n - p)).alias("fpr"), (tp / p).alias("tpr"))
    if collapse_ties:
        out = out.groupBy("threshold").agg(F.max("position").alias("position"), F.max("fpr").alias("fpr"), F.max("tpr").alias("tpr"))
    return out


def auc(points: DataFrame, x: str = "fpr", y: str = "tpr", order: str = "position") -> DataFrame:
    """One row: signed trapezoid area along the order; neighbours meet by position, not in one window."""
    now = points.select(F.col(order).alias("_o"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    before = points.select((F.col(order) + 1).alias("_o"), F.col(x).alias("_px"), F.col(y).alias("_py"))
    area = (F.col("_x") - F.col("_px")) * (F.col("_y") + F.col("_py")) / 2
    return now.join(before, "_o").agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("auc"))


def pooled_auc(df: DataFrame, y_true: str, score: str) -> DataFrame:
    """One row: the area with ties counted half, from counts of (score, label)."""
    per = df.select(valid(score).alias("s"), F.col(y_true).cast("double").alias("y")).where("s IS NOT NULL AND y IS NOT NULL").groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    per = per.withColumn("_b", with_bucket("s", buckets_of(per, "s")))
    base, total = {}, 0.0
    for b, k in sorted((r["_b"], r["k"]) for r in per.groupBy("_b").agg(F.sum("n").alias("k")).collect()):
        base[b], total = int(total), total + k
    w = Window.partitionBy("_b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    below = F.sum("n").over(w) - F.col("n") + _offset_column(base)
    parts = per.select("p", "n", (F.col("p") * (below + F.col("n") / 2)).alias("a"))
    return parts.agg(ratio(F.sum("a"), F.sum("p") * F.sum("n"), 0.5).alias("auc"))


def normalised_confusion(counts_df: DataFrame) -> DataFrame:
    """Confusion counts with each true class's shares."""
    w = Window.partitionBy("y")
    return counts_df.withColumn("share", ratio(F.col("n").cast("double"), F.sum("n").over(w).cast("double")))


def mismatches(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """The rows with a flag for predictions that differ from the truth."""
    return df.withColumn("mismatch", ~F.col(y_true).eqNullSafe(F.col(y_pred)))
