"""Connected components of a large graph, by alternating large-star and small-star joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another one; root is the smallest node of its component.

    Each round joins every node with its smallest neighbour and is written to the checkpoint folder; only a count and
    a checksum come to the driver. Rounds grow with the logarithm of the longest chain. Nulls and loops are dropped;
    repeated edges count once; without edges the result has no rows.
    """
    at = checkpointed(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        state = at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = at.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = checkpointed(lowest.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
