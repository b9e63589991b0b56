"""Scalers, imputer and encoder: fit is one aggregate, transform a projection of literals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import real, valid


def check_range(feature_range) -> tuple[float, float]:
    if not isinstance(feature_range, tuple) or len(feature_range) != 2:
        raise ValueError("feature_range is a tuple of two")
    lo, hi = map(float, feature_range)
    if not lo < hi:
        raise ValueError("feature_range needs low < high")
    return lo, hi


class Stage:
    """A fitted or unfitted step over named columns; `transform` keeps all other columns."""

    columns: list[str]
    fitted = False

    def expressions(self) -> dict[str, Column]:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise ValueError(f"{type(self).__name__} is not fitted: call fit or partial_fit first")
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        return df.withColumns(self.expressions())

    def fit(self, df: DataFrame, y: str | None = None) -> Stage:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame, y: str | None = None) -> DataFrame:
        return self.fit(df, y).transform(df)

    def _one_row(self, df: DataFrame, *parts: Column):
        row = df.agg(F.count(F.lit(1)).alias("_rows"), *parts).first()
        if not row["_rows"]:
            raise ValueError("no rows to fit")
        return row


def standardised(c: str, mean: float, std: float) -> Column:
    return (real(c) - F.lit(mean)) / F.lit(std)


def rescaled(c: str, low: float, high: float, lo: float, hi: float) -> Column:
    span = high - low or 1.0
    return (real(c) - F.lit(low)) / F.lit(span) * F.lit(hi - lo) + F.lit(lo)


@dataclass
class StandardScaler(Stage):
    """(x - mean) / population std; a constant column divides by 1, an all-missing one has mean 0."""

    columns: list[str]
    mean_: dict[str, float] = field(default_factory=dict)
    std_: dict[str, float] = field(default_factory=dict)

    def fit(self, df, y=None):
        row = self._one_row(df, *(f(valid(c)).alias(f"{k}{i}") for i, c in enumerate(self.columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))))
        self.mean_ = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(self.columns)}
        self.std_ = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(self.columns)}
        self.fitted = True
        return self

    def expressions(self):
        return {c: standardised(c, self.mean_[c], self.std_[c]) for c in self.columns}


@dataclass
class MinMaxScaler(Stage):
    """To a range; a constant column goes to its low bound."""

    columns: list[str]
    feature_range: tuple[float, float] = (0.0, 1.0)
    min_: dict[str, float] = field(default_factory=dict)
    max_: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        check_range(self.feature_range)

    def fit(self, df, y=None):
        row = self._one_row(df, *(f(valid(c)).alias(f"{k}{i}") for i, c in enumerate(self.columns) for k, f in (("l", F.min), ("h", F.max))))
        self.min_ = {c: row[f"l{i}"] if row[f"l{i}"] is not None else 0.0 for i, c in enumerate(self.columns)}
        self.max_ = {c: row[f"h{i}"] if row[f"h{i}"] is not None else 0.0 for i, c in enumerate(self.columns)}
        self.fitted = True
        return self

    def expressions(self):
        return {c: rescaled(c, self.min_[c], self.max_[c], *self.feature_range) for c in self.columns}


STRATEGIES = ("mean", "median", "constant")


@dataclass
class SimpleImputer(Stage):
    """Missing values become the column's mean or median, or a constant (also where all are missing)."""

    columns: list[str]
    strategy: str = "mean"
    fill_value: float = 0.0
    fill_: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")

    def fit(self, df, y=None):
        f = {"mean": F.avg, "median": lambda x: F.percentile(x, 0.5), "constant": lambda x: F.lit(self.fill_value)}[self.strategy]
        row = self._one_row(df, *(f(valid(c)).alias(f"f{i}") for i, c in enumerate(self.columns)))
        self.fill_ = {c: row[f"f{i}"] if row[f"f{i}"] is not None else self.fill_value for i, c in enumerate(self.columns)}
        self.fitted = True
        return self

    def expressions(self):
        return {c: F.coalesce(valid(c), F.lit(float(self.fill_[c]))) for c in self.columns}


@dataclass
class OneHotEncoder(Stage):
    """One 0/1 column per sorted category, `<column>_<category>`; categories are few by contract."""

    columns: list[str]
    handle_unknown: str = "error"
    categories_: dict[str, list] = field(default_factory=dict)

    def __post_init__(self):
        if self.handle_unknown not in ("error", "ignore"):
            raise ValueError("handle_unknown is error or ignore")

    def fit(self, df, y=None):
        row = self._one_row(df, *(F.array_sort(F.collect_set(c)).alias(f"c{i}") for i, c in enumerate(self.columns)))
        self.categories_ = {c: list(row[f"c{i}"]) for i, c in enumerate(self.columns)}
        self.fitted = True
        return self

    def output_columns(self) -> list[str]:
        return [f"{c}_{v}" for c in self.columns for v in self.categories_[c]]

    def expressions(self):
        out = {}
        for c in self.columns:
            known = F.col(c).isin(self.categories_[c])
            for v in self.categories_[c]:
                hot = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
                if self.handle_unknown == "error":
                    hot = F.when(F.coalesce(known, F.lit(False)), hot).otherwise(F.raise_error(F.lit(f"unknown category in {c}")))
                out[f"{c}_{v}"] = hot
        return out
