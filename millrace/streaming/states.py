"""Mergeable running states: each chunk is one aggregate, merging happens on a few numbers.

Every state remembers the last applied batch id, so that a replayed micro-batch changes
nothing.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import valid
from ..operators.prep import OneHotEncoder, Stage, check_range, rescaled, standardised

NAN = float("nan")


@dataclass
class Moments:
    """Count, mean, sum of squared deviations, minimum and maximum of one stream of numbers."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    low: float = math.inf
    high: float = -math.inf

    def merge(self, o: Moments) -> Moments:
        if not o.n:
            return self
        n, d = self.n + o.n, o.mean - self.mean
        return Moments(n, self.mean + d * o.n / n, self.m2 + o.m2 + d * d * self.n * o.n / n, min(self.low, o.low), max(self.high, o.high))

    def variance(self, ddof: int = 0) -> float:
        return self.m2 / (self.n - ddof) if self.n > ddof else NAN


def moment_columns(c: str, tag: str) -> list[Column]:
    x = valid(c)
    return [F.count(x).alias(f"n{tag}"), F.avg(x).alias(f"a{tag}"), F.var_pop(x).alias(f"v{tag}"), F.min(x).alias(f"l{tag}"), F.max(x).alias(f"h{tag}")]


def moments_of(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, Moments]]:
    """Rows and each column's moments, one pass."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *(p for i, c in enumerate(columns) for p in moment_columns(c, str(i)))).first()
    out = {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        out[c] = Moments(n, row[f"a{i}"], row[f"v{i}"] * n, row[f"l{i}"], row[f"h{i}"]) if n else Moments()
    return row["_rows"], out


class Replayable:
    """Skips a batch that has been applied."""

    last_batch: int | None = None

    def fresh(self, batch_id: int | None) -> bool:
        return batch_id is None or self.last_batch is None or batch_id > self.last_batch

    def applied(self, batch_id: int | None) -> None:
        """To be called after success, so that a batch that failed is applied when it comes again."""
        if batch_id is not None:
            self.last_batch = batch_id


class StreamingStats(Replayable):
    """Running statistics of one column."""

    def __init__(self):
        self.state = Moments()

    def update(self, value: float) -> StreamingStats:
        if value is not None and not math.isnan(value):
            self.state = self.state.merge(Moments(1, float(value), 0.0, value, value))
        return self

    def update_many(self, df: DataFrame, column: str, batch_id: int | None = None) -> StreamingStats:
        if self.fresh(batch_id):
            self.state = self.state.merge(moments_of(df, [column])[1][column])
            self.applied(batch_id)
        return self

    def to_dict(self) -> dict:
        s = self.state
        some = s.n > 0
        return {
            "count": s.n, "mean": s.mean if some else NAN, "variance": s.variance(), "sample_variance": s.variance(1),
            "std": math.sqrt(s.variance()) if some else NAN, "sample_std": math.sqrt(s.variance(1)) if s.n > 1 else NAN,
            "min": s.low if some else NAN, "max": s.high if some else NAN,
        }

    def __getattr__(self, name):
        if name in ("count", "mean", "variance", "sample_variance", "std", "sample_std", "min", "max"):
            return self.to_dict()[name]
        raise AttributeError(name)


class ChunkStats(Replayable):
    """Running statistics of several columns; only the window mean looks at the last chunks alone."""

    def __init__(self, columns: list[str], window_size: int | None = None):
        self.columns, self.window_size = list(columns), window_size
        self.state = {c: Moments() for c in columns}
        self.chunk_means: deque = deque(maxlen=window_size)
        self.chunks = 0

    def update_stats(self, df: DataFrame, batch_id: int | None = None) -> ChunkStats:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        if not self.fresh(batch_id):
            return self
        rows, new = moments_of(df, self.columns)
        if rows:
            self.state = {c: self.state[c].merge(new[c]) for c in self.columns}
            self.chunk_means.append({c: new[c].mean if new[c].n else NAN for c in self.columns})
            self.chunks += 1
        self.applied(batch_id)
        return self

    mean_ = property(lambda s: {c: m.mean if m.n else 0.0 for c, m in s.state.items()})
    var_ = property(lambda s: {c: m.variance() for c, m in s.state.items()})
    std_ = property(lambda s: {c: math.sqrt(m.variance()) for c, m in s.state.items()})
    min_ = property(lambda s: {c: m.low for c, m in s.state.items()})
    max_ = property(lambda s: {c: m.high for c, m in s.state.items()})

    @property
    def window_mean_(self) -> dict[str, float]:
        n = len(self.chunk_means)
        return {c: sum(m[c] for m in self.chunk_means) / n if n else NAN for c in self.columns}

    def chunk_histogram(self, df: DataFrame, column: str, bins: int = 10) -> DataFrame:
        from ..functions.aggs import histogram

        return histogram(df, column, bins)

    def to_dict(self) -> dict:
        return {"chunks": self.chunks, "mean": self.mean_, "var": self.var_, "std": self.std_, "min": self.min_, "max": self.max_, "window_mean": self.window_mean_}


class _StreamStage(Stage, Replayable):
    def reset(self):
        self.fitted, self.last_batch = False, None

    def fit(self, df, y=None):
        self.reset()
        return self.partial_fit(df)

    def partial_fit(self, df: DataFrame, batch_id: int | None = None):
        if self.fresh(batch_id):
            rows = self._learn(df)
            if not rows:
                raise ValueError("empty chunk")
            self.fitted = True
            self.applied(batch_id)
        return self


class StreamingStandardScaler(_StreamStage):
    def __init__(self, columns: list[str]):
        self.columns = list(columns)
        self.reset()

    def reset(self):
        super().reset()
        self.state = {c: Moments() for c in self.columns}

    def _learn(self, df):
        rows, new = moments_of(df, self.columns)
        self.state = {c: self.state[c].merge(new[c]) for c in self.columns}
        return rows

    def expressions(self):
        return {c: standardised(c, m.mean, math.sqrt(m.variance()) or 1.0 if m.n else 1.0) for c, m in self.state.items()}


class StreamingMinMaxScaler(StreamingStandardScaler):
    def __init__(self, columns: list[str], feature_range: tuple[float, float] = (0.0, 1.0)):
        check_range(feature_range)
        self.feature_range = feature_range
        super().__init__(columns)

    def expressions(self):
        return {c: rescaled(c, m.low if m.n else 0.0, m.high if m.n else 0.0, *self.feature_range) for c, m in self.state.items()}


#: Values that the running median looks back on.
MEDIAN_BUFFER = 500


class StreamingImputer(_StreamStage):
    """Mean over all history, median over the last MEDIAN_BUFFER valid values, or a constant."""

    def __init__(self, columns: list[str], strategy: str = "mean", fill_value: float = 0.0, order: str | None = None):
        from ..operators.prep import STRATEGIES

        if strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
        self.columns, self.strategy, self.fill_value, self.order = list(columns), strategy, fill_value, order
        self.reset()

    def reset(self):
        super().reset()
        self.state = {c: Moments() for c in self.columns}
        self.tail = {c: deque(maxlen=MEDIAN_BUFFER) for c in self.columns}

    def _learn(self, df):
        rows, new = moments_of(df, self.columns)
        self.state = {c: self.state[c].merge(new[c]) for c in self.columns}
        if self.strategy == "median":
            for c in self.columns:
                last = df.select(valid(c).alias("x"), (F.col(self.order) if self.order else F.monotonically_increasing_id()).alias("o")).where("x IS NOT NULL").orderBy(F.desc("o")).limit(MEDIAN_BUFFER).collect()
                self.tail[c].extend(r["x"] for r in reversed(last))
        return rows

    def fill(self, c: str) -> float:
        if self.strategy == "mean" and self.state[c].n:
            return self.state[c].mean
        if self.strategy == "median" and self.tail[c]:
            v = sorted(self.tail[c])
            return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
        return float(self.fill_value)

    def expressions(self):
        return {c: F.coalesce(valid(c), F.lit(self.fill(c))) for c in self.columns}


class StreamingOneHotEncoder(_StreamStage):
    """Categories grow from chunk to chunk and stay sorted; unknown ones give zeros by default."""

    def __init__(self, columns: list[str], handle_unknown: str = "ignore"):
        self.columns = list(columns)
        self.inner = OneHotEncoder(self.columns, handle_unknown)
        self.reset()

    def reset(self):
        super().reset()
        self.inner.categories_ = {c: [] for c in self.columns}

    def _learn(self, df):
        row = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.collect_set(c).alias(f"c{i}") for i, c in enumerate(self.columns))).first()
        for i, c in enumerate(self.columns):
            self.inner.categories_[c] = sorted({*self.inner.categories_[c], *row[f"c{i}"]})
        return row["_rows"]

    def output_columns(self) -> list[str]:
        return self.inner.output_columns()

    def expressions(self):
        return self.inner.expressions()

    def encoded(self) -> Column:
        """All indicators as one array, whose schema does not change as categories grow."""
        return F.array(*self.inner.expressions().values())


@dataclass
class StreamingMetrics(Replayable):
    """Accumulated and rolling metrics of label pairs, and the pooled AUC of scores in [0, 1].

    Scores in one of `score_bins` equal bins count as ties; others are an error.

    compat: a label is truncated to an integer before it is checked, and the AUC is the
    constant 0.5 from the second scored chunk on.
    """

    window_size: int | None = None
    n_classes: int = 2
    compat: bool = False
    matrix: dict = field(default_factory=dict)
    total: int = 0
    chunks: int = 0
    scored: int = 0
    history: list = field(default_factory=list)
    scores: dict = field(default_factory=dict)
    #: Scores are pooled in this many equal bins of [0, 1], so that the state is bounded.
    score_bins: int = 10_000

    def update(self, df: DataFrame, y_true: str, y_pred: str, y_score: str | None = None, batch_id: int | None = None):
        if not self.fresh(batch_id):
            return self
        y, p = valid(y_true), valid(y_pred)
        rows = df.select(y.alias("y"), p.alias("p"), *([F.col(y_score).cast("double").alias("s")] if y_score else [])).where("y IS NOT NULL AND p IS NOT NULL")
        if self.compat:
            rows = rows.withColumn("y", F.col("y").cast("int").cast("double")).withColumn("p", F.col("p").cast("int").cast("double"))
        cells = {(r["y"], r["p"]): r["n"] for r in rows.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not cells:
            self.applied(batch_id)
            return self
        binned = {}
        if y_score:  # before anything is added, so that a failure leaves the state as it was
            if rows.where("NOT isnan(s) AND (s < 0 OR s > 1)").limit(1).count():
                raise ValueError("scores lie in [0, 1]")
            bin_of = F.least(F.floor(F.col("s") * self.score_bins), F.lit(self.score_bins - 1))
            binned = {(r["b"], r["y"]): r["count"] for r in rows.where("NOT isnan(s)").groupBy(bin_of.alias("b"), "y").count().collect()}
        if self.n_classes == 2 and any(v not in (0.0, 1.0) for c in cells for v in c):
            raise ValueError("labels are 0 or 1")
        self.chunks += 1
        self.total += sum(cells.values())
        for (a, b), n in cells.items():
            if a in range(self.n_classes) and b in range(self.n_classes):
                self.matrix[a, b] = self.matrix.get((a, b), 0) + n
        self.history.append(self._rates(cells, sum(cells.values())))
        if y_score:
            self.scored += 1
            for (b, label), n in binned.items():
                pos, neg = self.scores.get(b, (0, 0))
                self.scores[b] = (pos + n, neg) if label == 1 else (pos, neg + n)
        self.applied(batch_id)
        return self

    @staticmethod
    def _rates(cells: dict, total: int) -> dict:
        tp, fp, fn = cells.get((1, 1), 0), cells.get((0, 1), 0), cells.get((1, 0), 0)
        precision = tp / (tp + fp) if tp + fp else 0.0
        recall = tp / (tp + fn) if tp + fn else 0.0
        right = sum(n for (a, b), n in cells.items() if a == b)
        return {"accuracy": right / total if total else 0.0, "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0}

    def auc(self) -> float | None:
        if self.compat:
            return 0.5 if self.scored > 1 else None
        pos = neg = area = 0.0
        for _, (p, n) in sorted(self.scores.items()):
            area += p * (neg + n / 2)
            pos, neg = pos + p, neg + n
        return area / (pos * neg) if pos and neg else None

    @property
    def accuracy_history(self) -> list[float]:
        return [h["accuracy"] for h in self.history]

    @property
    def confusion_matrix_accumulated(self) -> list[list[int]]:
        return [[self.matrix.get((a, b), 0) for b in range(self.n_classes)] for a in range(self.n_classes)]

    def result(self) -> dict:
        rates = self._rates(self.matrix, self.total)
        if self.n_classes > 2:
            rates |= {"precision": 0.0, "recall": 0.0, "f1": 0.0}
        recent = self.history[-self.window_size:] if self.window_size else self.history
        rolling = {f"rolling_{k}": sum(h[k] for h in recent) / len(recent) for k in ("accuracy", "precision", "recall", "f1")} if recent else {}
        out = {"total_samples": self.total, "n_chunks": self.chunks, **rates, **rolling, "confusion_matrix": self.confusion_matrix_accumulated}
        if (area := self.auc()) is not None:
            out["auc"] = area
        return out

    def reset(self):
        self.__init__(self.window_size, self.n_classes, self.compat)
