"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.operators.shared import durable, hot_join


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (u, v), of one type: root is the least node that is reachable. Large-star
    and small-star rounds in turn; each ends in a checkpoint and is compared by count and hash alone, and hubs
    meet a broadcast table. Edges of a node to itself are no edges; repeated ones are one."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    e = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(e)
    while seen[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # Larger neighbours point at the least of a node and its neighbours.
        large = durable(hot_join(both, least, "u", "n", 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # Then every node's smaller neighbours and itself at the least of them.
        small = hot_join(large, low, "u", "n", 2 * seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        before, seen = seen, mark(e)
        if before == seen:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select("v", "v").distinct())
