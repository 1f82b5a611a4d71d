"""Connected components of an edge list, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node of each node's component: rows (node, label) for every node that has an edge.

    Alternates two star steps until nothing changes: each node links its greater neighbours to the smallest node around
    it, then its smaller ones. Both only need minima by key, which are combined before the shuffle, and the rounds grow
    with the logarithm of the longest chain. Every round is written to the shared folder, so the lineage stays short;
    no edge reaches the driver.
    """
    now = common.settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("w")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("w").alias("u"), F.col("u").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where(F.col("w") > F.col("u")).select(F.col("w").alias("u"), F.col("low").alias("w")).distinct()
        least = large.groupBy("u").agg(F.min("w").alias("low"))
        small = large.join(least, "u").select("u", "w", "low")
        linked = small.select("u", F.col("low").alias("w")).unionByName(small.where("w <> low").select(F.col("w").alias("u"), F.col("low").alias("w")))
        new = common.settle(linked.where("u <> w").distinct(), "edges")
        seen = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "w").cast("decimal(20,0)")).alias("s"), F.countDistinct("u").alias("k")).first()
        common.discard(now)
        now = new
        if seen["n"] == seen["k"] and seen == state or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("w").alias("label")).unionByName(now.select(F.col("w").alias("node"), F.col("w").alias("label")).distinct())
        state = seen
