"""Connected components over an edge table, without any group in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the undirected ``edges`` (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star rounds; each is a minimum per node (combined before the shuffle) and a join, whose
    hot nodes adaptive execution splits.  Every round is checkpointed in the shared folder.
    """
    shared_dir(edges.sparkSession)
    now = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    before = None
    while True:
        facts = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        if facts == before or not facts["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        before = facts
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = small.union(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
