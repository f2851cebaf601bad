"""Connected components by alternating stars; labels and edges stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every node of ``(a, b)`` but the roots, the smallest node of its component.

    Each round links every node's larger neighbours to its smallest (large star), then its smaller ones (small star), with
    one minimum and one join per star; the number of rounds grows with the logarithm of the longest path. Every round is
    written, so a lost executor repeats one round at most.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current, before = materialize(current.distinct()), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return current.toDF("node", "root")
        before = state
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
