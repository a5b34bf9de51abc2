"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finegrid.llm.common import saved


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, move to the least node that it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(u, v)`` edges between comparable ids -> ``(node, root)``, root being the least id of the component.

    Rows ``u = v`` and repeated edges are ignored; only nodes with an edge come back, an empty table gives an
    empty one.  Each round is written to the shared folder, so a lost executor costs one round at most.  A round
    joins edges with per-node minima that were reduced before the shuffle; a hub with a third of all edges is
    split by adaptive execution.  The number of rounds grows with the logarithm of the longest path.
    """
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if row == mark or row[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = row
        now = saved(_stars(now), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
