"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its least node.

    Null ends and loops are ignored. Each round replaces a node's neighbours by links
    to the least of them, so stars of any size cost one row an edge, and the edge list
    never grows. The rounds go through stored tables; only a count and a checksum of
    the edges reach the driver.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components", tidy=True)
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, seen = scratch.save(start, "edges-0"), None
    for k in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        # the least neighbour may itself be the node: then its links stay as they are
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = (
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        after = scratch.save(after, f"edges-{k}")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges-{k - 1}")
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
