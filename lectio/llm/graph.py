"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et
al., "Connected Components in MapReduce and Beyond", 2014), each step staged in the shared folder.

Joins carry one minimum per node, never a list of neighbours; the minima of hubs, of which there are few,
are broadcast, so that no task gets a hub's edges as a whole. Nothing but two counters per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_size, stage, unstage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the component's smallest node) for every node of the edges (a, b)."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if seen == last or not seen[0]:
            break
        last = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m"), F.count("*").alias("_n")).select("a", F.least("a", "_m").alias("_m"), "_n")
        large = join_by_size(both, least, ["a"], "_n", 2 * seen[0]).where("b > a").select(
            F.col("b").alias("a"), F.col("_m").alias("b")
        ).where("a <> b").distinct()
        large, before = stage(large, "large-star"), now
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").where("b <> _m").select(
            F.col("b").alias("a"), F.col("_m").alias("b")
        ).unionByName(least.select("a", F.col("_m").alias("b")))
        now = stage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small-star")
        unstage(before, large)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(
        F.col("a").alias("node"), F.col("b").alias("component")
    ).unionByName(roots.select("node", F.col("node").alias("component")))
