"""Checks of numeric frames, one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import real


def check_array(df: DataFrame, columns: list[str], ensure_1d: bool = False, ensure_2d: bool = False, allow_nan: bool = True, allow_inf: bool = True) -> DataFrame:
    """The columns as doubles; ValueError where shape or content is not allowed."""
    if ensure_1d and ensure_2d:
        raise ValueError("either one or two dimensions")
    if not columns:
        raise ValueError("no columns")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if ensure_1d and len(columns) != 1:
        raise ValueError("one column is expected")
    out = df.withColumns({c: real(c) for c in columns})
    bad = []
    if not allow_nan:
        bad += [F.coalesce(F.bool_or(F.isnan(c) | F.col(c).isNull()), F.lit(False)) for c in columns]
    if not allow_inf:
        bad += [F.coalesce(F.bool_or(F.abs(c) == float("inf")), F.lit(False)) for c in columns]
    if bad and any(out.agg(*(b.alias(f"b{i}") for i, b in enumerate(bad))).first()):
        raise ValueError("NaN or infinite values are not allowed")
    return out
