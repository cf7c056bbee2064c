"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlab.session import forget, written

#: Rounds grow with the logarithm of the longest path; this many would mean a fault.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges(a, b) of any orderable type, either direction, repeated or looping edges allowed.

    Returns (node, component): every node of some edge with the least node that can be reached from it. Edges with a
    null end say nothing. Each round is written to the shared folder: a lost executor costs one round at most, and only
    two numbers reach the driver. A node of very many edges is aggregated before its rows are shuffled and joined under
    skew handling, never gathered in one row.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct()
    first = last = written(e, "components")
    nodes = first.select(F.col("v").alias("node")).union(first.select("m")).distinct()
    e = first.where("v <> m")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy(F.col("v").alias("u")).agg(F.least(F.min("m"), F.min("v")).alias("least"))
        large = both.join(least, both.v == least.u).where("m > v").select(F.col("m").alias("v"), F.col("least").alias("m")).where("v <> m").distinct()
        least = large.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("least"))
        small = large.join(least, large.v == least.u)
        e = written(small.select(F.col("m").alias("v"), F.col("least").alias("m")).where("v <> m").union(least.select("u", "least")).distinct(), "components")
        if last is not first:
            forget(last)
        last = e
        now = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("v", "m"), F.lit(1 << 40)))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return nodes.join(e, nodes.node == e.v, "left").select("node", F.coalesce("m", "node").alias("component"))
