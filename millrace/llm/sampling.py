"""Bounded samples of labelled rows and score calibration for the trained operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Labels (languages) that are learned: the most frequent ones. Texts of more bytes than LONGEST do not teach.
MOST_LABELS, LONGEST = 256, 1 << 20


def _unit(id_col: str) -> Column:
    """A hash of the id in 40 bits."""
    return F.xxhash64(F.lit("sample"), F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 40) - 1))


def _chosen(rows: DataFrame, label: str, id_col: str, per_label: int) -> tuple[DataFrame, dict]:
    """The rows whose hash lies in their label's share, and all rows by label."""
    counted = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LABELS)
    counts = {r[0]: r[1] for r in counted.collect()}
    wanted = F.lit(False)
    for value, n in counts.items():
        most = min(1.0, per_label / n) * (1 << 40)
        wanted = wanted | ((F.col(label) == F.lit(value)) & (_unit(id_col) < F.lit(int(most))))
    return rows.where(wanted), counts


def _gathered(picked: DataFrame, id_col: str, label: str, text_col: str) -> list[tuple]:
    """(hash, label, text) of the picked rows, one text for each id, in order of hash."""
    texts = picked.where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= LONGEST)
    one = texts.groupBy(_unit(id_col).alias("h"), F.col(id_col).cast("string").alias("_i"), F.col(label).alias("label")).agg(F.min(text_col).alias("text"))
    return sorted(((r["h"], r["label"], r["text"]) for r in one.collect()), key=lambda r: (r[0], str(r[1]), r[2] or ""))


def labelled_sample(rows: DataFrame, label: str, id_col: str, text_col: str, per_label: int) -> list[tuple]:
    """About `per_label` rows of each label as (hash, label, text), chosen by a hash of the id.

    Each label's share is set from its count, so the sample's size does not follow the
    input. The hash makes the choice the same for any partitioning.
    """
    picked, _ = _chosen(rows, label, id_col, per_label)
    return _gathered(picked, id_col, label, text_col)


def sample_by_labels(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str, id_col: str, text_col: str, per_label: int) -> tuple[list[tuple], float]:
    """The sample of a table of 0/1 labels, and the share of label 1 among all that may teach.

    Ids are chosen on the labels alone; only these few go to the documents (a broadcast of
    about 2 per_label rows), so that no other text moves. held_out is a column of the id. A
    label that repeats counts once; an id with both labels, or a null id, teaches nothing.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col(id_col).isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    known = known.groupBy(id_col).agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other").select(id_col, "_label")
    picked, counts = _chosen(known, "_label", id_col, per_label)
    picked = picked.select(F.col(id_col).alias("_lid"), "_label")
    texts = docs.select(id_col, text_col).join(F.broadcast(picked), F.col(id_col) == F.col("_lid"))
    return _gathered(texts, id_col, "_label", text_col), counts.get(1, 0) / max(sum(counts.values()), 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: float | None = None, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for a logistic fit; the last weight is the intercept.

    prior: share of label 1 outside the sample; weights undo the sample's balance.
    """
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    rows = np.ones(len(y))
    if prior is not None and 0 < y.sum() < len(y):
        share = y.mean()
        rows = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((rows * (np.logaddexp(0, z) - y * z)).sum() + ridge * (w @ w) / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (rows * (p - y)) + ridge * w
        hess = (x.T * (rows * p * (1 - p))) @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-8:  # a full step may overshoot
            step = step / 2
        w, now = w - step, then
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_rising(x: np.ndarray, y: np.ndarray, prior: float | None = None, ridge: float = 1e-2) -> list[float]:
    """A logistic fit whose slopes are not negative: a feature that falls with the label is left out."""
    use = list(range(x.shape[1]))
    while True:
        w = fit_logistic(x[:, use], y, prior, ridge=ridge)
        rising = [c for c, v in zip(use, w[:-1]) if v >= 0]
        if len(rising) == len(use):
            break
        use = rising
    out = [0.0] * x.shape[1] + [float(w[-1])]
    for c, v in zip(use, w[:-1]):
        out[c] = float(v)
    return out


def squash(z: float) -> float:
    z = min(max(z, -40.0), 40.0)
    return 1 / (1 + math.exp(-z))
