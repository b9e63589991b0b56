"""Hoeffding trees grown chunk by chunk, bagged trees and forests, predicting as compiled Columns.

A chunk costs a few aggregates: leaves' class counts over all rows, and a bounded sample
of each leaf's rows (the smallest row hashes, so the sample is uniform over the stream)
on which the driver looks for a split. Nothing unbounded reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import real


@dataclass
class Node:
    depth: int = 0
    counts: dict = field(default_factory=dict)
    n: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    sample: dict = field(default_factory=dict)  # row hash -> (weight, label, values)


def impurity(counts: np.ndarray) -> float:
    n = counts.sum()
    return float(1 - ((counts / n) ** 2).sum()) if n else 0.0


class StreamingDecisionTree:
    """split_rule: "reference" accepts a gain of at least min(bound, 1e-6), "hoeffding" one above the bound.

    Missing values go to the child with more rows, in training and prediction; with
    compat=True training sends them right.
    """

    def __init__(self, columns: list[str], label: str, max_depth: int = 10, delta: float = 1e-7, min_samples_split: int = 50, n_candidate_thresholds: int = 10, seed: int = 0, split_rule: str = "reference", compat: bool = False):
        if split_rule not in ("reference", "hoeffding"):
            raise ValueError("split_rule is reference or hoeffding")
        self.columns, self.label = list(columns), label
        self.max_depth, self.delta, self.min_samples_split = max_depth, delta, min_samples_split
        self.n_candidate_thresholds, self.seed, self.split_rule, self.compat = n_candidate_thresholds, seed, split_rule, compat
        self.nodes: list[Node] = []
        self.classes_: list = []
        self.last_batch: int | None = None

    @property
    def sample_cap(self) -> int:
        return max(4 * self.min_samples_split, 400)

    def _route(self, train: bool) -> Column:
        """The leaf of a row as nested conditions."""
        def at(i: int) -> Column:
            node = self.nodes[i]
            if node.feature is None:
                return F.lit(i)
            x = real(node.feature)
            missing = x.isNull() | F.isnan(x)
            to_right = self.nodes[node.right].n > self.nodes[node.left].n or (train and self.compat)
            low = (x <= node.threshold) & ~missing
            return F.when(low if to_right else low | missing, at(node.left)).otherwise(at(node.right))  # each child once

        return at(0)

    def weight(self) -> Column:
        return F.lit(1)

    def partial_fit(self, df: DataFrame, classes: list | None = None, batch_id: int | None = None) -> StreamingDecisionTree:
        if batch_id is not None:
            if self.last_batch is not None and batch_id <= self.last_batch:
                return self
        missing = [c for c in [*self.columns, self.label] if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        if not self.nodes:
            self.nodes = [Node()]
            self.classes_ = sorted(classes) if classes is not None else []
        fixed = classes is not None
        rows = df.select(*(real(c).alias(c) for c in self.columns), F.col(self.label).alias("_y")).where("_y IS NOT NULL")
        rows = rows.withColumn("_h", F.xxhash64(F.lit(self.seed), *self.columns, "_y")).withColumn("_w", self.weight()).where("_w > 0")
        rows = rows.withColumn("_leaf", self._route(True))
        for r in rows.groupBy("_leaf", "_y").agg(F.sum("_w").alias("n")).collect():
            if r["_y"] not in self.classes_:
                if fixed:
                    raise ValueError(f"label {r['_y']} is not among the classes")
                self.classes_ = sorted([*self.classes_, r["_y"]])
            node = self.nodes[r["_leaf"]]
            node.counts[r["_y"]] = node.counts.get(r["_y"], 0) + r["n"]
            node.n += r["n"]
        w = Window.partitionBy("_leaf").orderBy("_h")
        for r in rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= self.sample_cap).drop("_rn").collect():
            node = self.nodes[r["_leaf"]]
            node.sample[r["_h"], len(node.sample)] = (r["_w"], r["_y"], [r[c] for c in self.columns])
        for i in range(len(self.nodes)):
            node = self.nodes[i]
            if node.feature is None:
                if len(node.sample) > self.sample_cap:
                    node.sample = dict(sorted(node.sample.items(), key=lambda kv: kv[0])[:self.sample_cap])
                self._try_split(node)
        if batch_id is not None:
            self.last_batch = batch_id
        return self

    def _vector(self, counts: dict) -> np.ndarray:
        return np.array([counts.get(c, 0) for c in self.classes_], float)

    def _try_split(self, node: Node) -> None:
        parent = impurity(self._vector(node.counts))
        if node.depth >= self.max_depth or node.n < self.min_samples_split or parent <= 0 or not node.sample:
            return
        weight = np.array([s[0] for s in node.sample.values()], float)
        label = np.array([self.classes_.index(s[1]) for s in node.sample.values()])
        values = np.array([[math.nan if v is None else v for v in s[2]] for s in node.sample.values()], float)
        best = (math.inf, "", 0.0)
        hot = np.eye(len(self.classes_))[label] * weight[:, None]
        for j, name in enumerate(self.columns):
            ok = ~np.isnan(values[:, j])
            if not ok.any():
                continue
            x, h = values[ok, j], hot[ok]
            for t in np.unique(np.percentile(x, np.linspace(10, 90, self.n_candidate_thresholds))):
                low = x <= t
                if low.all() or not low.any():
                    continue
                a, b = h[low].sum(0), h[~low].sum(0)
                g = (a.sum() * impurity(a) + b.sum() * impurity(b)) / (a.sum() + b.sum())
                if g < best[0]:
                    best = (g, name, float(t))
        if not best[1]:
            return
        gain = parent - best[0]
        bound = math.sqrt(math.log(1 / self.delta) / (2 * node.n))
        if not (gain >= min(bound, 1e-6) if self.split_rule == "reference" else gain > bound):
            return
        j = self.columns.index(best[1])
        ok = ~np.isnan(values[:, j])
        kids = []
        for side in (values[:, j] <= best[2], values[:, j] > best[2]):
            c = hot[ok & side].sum(0)
            kids.append(Node(node.depth + 1, {k: v for k, v in zip(self.classes_, c.tolist()) if v}, float(c.sum())))
        node.feature, node.threshold, node.sample = best[1], best[2], {}
        node.left, node.right = len(self.nodes), len(self.nodes) + 1
        self.nodes += kids

    def fit(self, df: DataFrame, y: str | None = None) -> StreamingDecisionTree:
        self.nodes, self.classes_, self.last_batch = [], [], None
        return self.partial_fit(df)

    def _by_leaf(self, make) -> Column:
        if not self.nodes:
            raise ValueError("not fitted: call partial_fit first")
        table = [x for i, n in enumerate(self.nodes) if n.feature is None for x in (F.lit(i), make(n))]
        return F.element_at(F.create_map(*table), self._route(False))

    def probability(self) -> Column:
        """array of class shares in the order of classes_; zeros in an empty leaf."""
        def shares(n: Node) -> Column:
            v = self._vector(n.counts)
            total = v.sum()
            return F.array(*(F.lit(float(x / total) if total else 0.0) for x in v))

        return self._by_leaf(shares)

    def prediction(self) -> Column:
        return self._by_leaf(lambda n: F.lit(self.classes_[int(np.argmax(self._vector(n.counts)))]))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction())

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", self.probability())

    @property
    def depth_(self) -> int:
        return max((n.depth for n in self.nodes), default=0)

    @property
    def n_leaves_(self) -> int:
        return sum(n.feature is None for n in self.nodes)

    def structure(self) -> list[tuple]:
        """(node, depth, feature, threshold, left, right, rows) of every node."""
        return [(i, n.depth, n.feature, n.threshold if n.feature else None, n.left, n.right, float(n.n)) for i, n in enumerate(self.nodes)]

    def render(self) -> str:
        if not self.nodes:
            return "<empty tree>"
        lines = []

        def walk(i: int, mark: str):
            n = self.nodes[i]
            what = f"{n.feature} <= {n.threshold:.6g}" if n.feature else f"leaf {n.counts}"
            lines.append("  " * n.depth + mark + what)
            if n.feature:
                walk(n.left, "yes: ")
                walk(n.right, "no: ")

        walk(0, "")
        return "\n".join(lines)


DecisionTreeClassifier = StreamingDecisionTree


class _BootstrapTree(StreamingDecisionTree):
    """A tree whose rows weigh as often as a Poisson(1) draw by their hash says."""

    def weight(self) -> Column:
        u = F.pmod(F.xxhash64(F.lit("bag"), F.col("_h"), F.lit(self.seed)), F.lit(1_000_000)) / 1_000_000
        w, p, cumulative = F.lit(0), math.exp(-1), 0.0
        for k in range(1, 8):
            cumulative += p
            w = F.when(u >= cumulative, F.lit(k)).otherwise(w)
            p /= k
        return w


class StreamingBaggingClassifier:
    """Soft vote of trees on bootstrap weights."""

    def __init__(self, columns: list[str], label: str, n_estimators: int = 10, seed: int = 0, **tree):
        if n_estimators < 1:
            raise ValueError("at least one tree")
        self.columns, self.label = list(columns), label
        self.trees = [_BootstrapTree(self.subset(i, seed), label, seed=seed + i, **tree) for i in range(n_estimators)]
        self.classes_: list = []

    def subset(self, i: int, seed: int) -> list[str]:
        return self.columns

    def partial_fit(self, df: DataFrame, classes: list | None = None, batch_id: int | None = None):
        if not self.classes_:
            self.classes_ = sorted(classes) if classes is not None else [r[0] for r in df.select(self.label).where(F.col(self.label).isNotNull()).distinct().orderBy(self.label).collect()]
        for t in self.trees:
            t.partial_fit(df, self.classes_, batch_id)
        return self

    def fit(self, df: DataFrame, y: str | None = None):
        self.classes_ = []
        for t in self.trees:
            t.nodes, t.last_batch = [], None
        return self.partial_fit(df)

    def probability(self) -> Column:
        total = self.trees[0].probability()
        for t in self.trees[1:]:
            total = F.zip_with(total, t.probability(), lambda a, b: a + b)
        return F.transform(total, lambda x: x / len(self.trees))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", self.probability())

    def predict(self, df: DataFrame) -> DataFrame:
        best = F.array_position("_p", F.array_max("_p"))  # the first of equal ones
        return df.withColumn("_p", self.probability()).withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes_)), best.cast("int"))).drop("_p")


class StreamingRandomForest(StreamingBaggingClassifier):
    """Every tree sees one fixed subset of the features."""

    def __init__(self, columns: list[str], label: str, n_estimators: int = 10, max_features="sqrt", seed: int = 0, **tree):
        n = len(columns)
        if max_features == "sqrt":
            self.size = max(1, int(math.sqrt(n)))
        elif max_features == "log2":
            self.size = max(1, int(math.log2(n)))
        elif max_features in (None, "all"):
            self.size = n
        elif isinstance(max_features, int) and max_features > 0:
            self.size = min(max_features, n)
        else:
            raise ValueError("max_features is sqrt, log2, all, None or a positive integer")
        super().__init__(columns, label, n_estimators, seed, **tree)

    def subset(self, i: int, seed: int) -> list[str]:
        picked = np.random.default_rng(seed + i).choice(len(self.columns), self.size, replace=False)
        return [self.columns[j] for j in sorted(picked)]


EnsembleClassifier = StreamingRandomForest
