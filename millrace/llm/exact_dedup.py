"""Exact dedup: 128-bit content hash, smallest stable id kept, bytes compared inside groups.

Texts are grouped by their 128-bit hash together with their bytes, so the hash deals
and finds the groups and the byte comparison inside a group keeps colliding texts
apart. The grouping combines copies on the map side, before the only shuffle that
carries text: a group of copies of any size leaves one row per task. The classes then
go back to the documents by two hashes (16 and 32 bytes), without texts, through a
join whose hot keys Spark can split.

Rows: a null text counts as empty; empty texts are copies of each other; the smallest
id of a class stays and a null id stays only where all its copies have none (repeated
rows of the smallest id are all marked kept = they are the same document); an empty
table gives an empty one; columns besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    rows = rows.withColumn("_h128", F.unhex(F.md5("_norm")))
    groups = (
        rows.groupBy("_h128", "_norm")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_h128", F.sha2("_norm", 256).alias("_sha"), "keep_id", "group_size")
    )
    return (
        rows.select("_id", "_h128", F.sha2("_norm", 256).alias("_sha"))
        .join(groups, ["_h128", "_sha"])
        .select(
            F.col("_id").alias(id_col), "keep_id", "group_size",
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns and no others, whatever their names; of repeated rows one."""
    sha, own, its = (common.free_name(docs.columns, n) for n in ("sha", "own_id", "own_sha"))
    stay = classes(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(own), F.col("text_sha256").alias(its)).distinct()
    rows = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.col(sha) == F.col(its))
    return rows.join(stay, same, "left_semi").dropDuplicates([id_col, sha]).drop(sha)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.documents(spark, sf_dir))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
