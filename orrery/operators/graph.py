"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.storage import drop_staged, stage


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star rounds: every node points its larger,
    then its smaller, neighbours to the smallest node it knows.  Neighbourhoods
    are never gathered, only their minimum is, so a hub costs no more than its
    edges.  Each round is written to the shared folder and the one before it is
    deleted; rounds end when the edge set stays as it is.  Edges with a null end
    and loops are dropped; nodes of loops are kept as their own component.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    pairs = stage(pairs.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct(), "edges")
    nodes = pairs.filter("u = v").select(F.col("u").alias("node"))
    now, first = pairs.filter("u <> v"), True
    mark = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sums == mark or not sums["n"]:
            break
        mark = sums
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        before, now = now, stage(nxt.distinct(), "edges")
        if not first:
            drop_staged(before)
        first = False
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    alone = nodes.join(found, "node", "left_anti").withColumn("component", F.col("node"))
    return found.unionByName(alone)
