"""Delimited text with numeric or string fields."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_csv(spark: SparkSession, file_path: str, delimiter: str = ",", missing_value: float = float("nan"), skip_header: int = 0, dtype: str = "double", encoding: str | None = None) -> DataFrame:
    """Columns c0, c1, ...: empty and unreadable fields become missing_value, `#` starts a comment,
    blank lines are left out, lines of differing length are an error.

    skip_header leaves out the first lines of each file (of its first block).
    """
    if not isinstance(file_path, str):
        raise TypeError("file_path is text")
    if not isinstance(delimiter, str) or not delimiter:
        raise TypeError("delimiter is not empty")
    if skip_header < 0:
        raise ValueError("skip_header is not negative")
    try:
        reader = spark.read.option("encoding", encoding) if encoding else spark.read
        lines = reader.text(file_path)
    except AnalysisException as e:
        raise ValueError(f"cannot read {file_path}") from e
    if skip_header:
        # the id grows within a block of a file; a filter below it would change how blocks are packed
        numbered = lines.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
        place = F.row_number().over(Window.partitionBy("f").orderBy("i"))
        head = numbered.where("b = 0").select("f", "i", place.alias("n")).where(F.col("n") <= skip_header)
        lines = numbered.join(head, ["f", "i"], "left_anti").select("value")
    stripped = lines.select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v") if delimiter.strip() else F.regexp_replace("value", "#.*$", "").alias("v"))
    parts = stripped.where(F.trim("v") != "").select(F.split("v", re.escape(delimiter), -1).alias("p"))
    low, high = parts.agg(F.min(F.size("p")), F.max(F.size("p"))).first()
    if low is None:
        raise ValueError(f"{file_path} has no rows")
    if low != high:
        raise ValueError(f"rows of {low} to {high} fields")
    if dtype == "string":
        return parts.select(*(F.trim(F.col("p")[i]).alias(f"c{i}") for i in range(high)))
    return parts.select(*(F.coalesce(F.trim(F.col("p")[i]).try_cast(dtype), F.lit(missing_value).cast(dtype)).alias(f"c{i}") for i in range(high)))
