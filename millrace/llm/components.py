"""Connected components of a link table by alternating star contraction, all in Spark.

Each round lets every node's neighbours point at the smallest of them (large star, then
small star); rounds end when a round changes no link. Links are written to the shared
checkpoint folder each round, so no lineage grows and a lost executor costs one round; only
the last round's table stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _lowest(links: DataFrame) -> DataFrame:
    """(k, m): the smallest v of each u. The key is an expression, so that a join on it shuffles
    the links by themselves and Spark can split a hub with very many of them."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseOR(F.lit(0).cast("long")).alias("k"), "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("k", F.least("k", "m").alias("m"))
    return both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = _lowest(down)
    return (
        down.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
    )


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link. links: u, v."""
    spark = links.sparkSession

    last: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        """The round's links; the tables of the round before are deleted."""
        before, now = list(last), []
        found = common.written(df, "links", now)
        common.remove(spark, before)
        last[:] = now
        return found

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = kept(_small_star(kept(links)))  # each round reads its links twice
    before = mark(now)
    for _ in range(most_rounds):
        now = kept(_small_star(_large_star(now)))
        after = mark(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("links still change; raise most_rounds")
