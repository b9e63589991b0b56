"""The corpus pipeline: five stages from documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet in the shared folder and read again as the next stage's documents. All but the
last return the columns of documents, extra ones included whatever their names, and drop
whole rows. A null text counts as empty; a null id is an id of its own kind, and rows are
judged by id and text together; ties go to the smallest id, null last; of rows that repeat
id and text exact dedup keeps one; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, common, decontaminate, exact_dedup, similar, toxicity

#: Words of a shingle and Jaccard similarity of the near-duplicate stage.
SHINGLE, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models reject go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact_dedup.keepers(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at SIMILARITY the row of the smallest id stays; decided by row, not by id."""
    return similar.keepers(docs, SIMILARITY, SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the byte-level BPE round trip."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The classifier and the fingerprints are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
