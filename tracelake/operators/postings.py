"""Lists of members, such as the users of a table, in numbered blocks of bounded size.

Short lists are put in order by key. A hub's list doesn't fit one row, nor is it put in order by one task: its pairs are range
partitioned by key and member, each partition counts its members of a key, and a member's place is its place in the
partition and what earlier ones hold.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

#: The longest list that a task puts in order.
MOST = 100_000


def posting_blocks(pairs: DataFrame, keys: list[str], member: str, per_block: int = 4096) -> DataFrame:
    """keys, block (from 0), n (of the whole list), members: the distinct members of a key in order, per_block a row.

    Null members are left out; a key that has no others has no block.
    """
    distinct = checkpointed(pairs.select(*keys, member).filter(F.col(member).isNotNull()).distinct())
    hubs = checkpointed(distinct.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > MOST).select(*(F.col(c).alias(f"_{c}") for c in keys)))
    if hubs.isEmpty():
        return _short(distinct, keys, member, per_block)
    hub = _same(keys)
    return _short(distinct.join(hubs, hub, "left_anti"), keys, member, per_block).unionByName(_long(distinct.join(hubs, hub, "left_semi"), keys, member, per_block))


def _same(keys: list[str]):
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return same


def _short(distinct: DataFrame, keys: list[str], member: str, per_block: int) -> DataFrame:
    # All by key, so that one exchange does.
    own = Window.partitionBy(*keys)
    placed = distinct.withColumns({"_place": F.row_number().over(own.orderBy(member)), "_n": F.count("*").over(own)})
    return _blocks(placed, F.col("_place"), F.col("_n"), keys, member, per_block)


def _long(distinct: DataFrame, keys: list[str], member: str, per_block: int) -> DataFrame:
    ranged = checkpointed(distinct.repartitionByRange(*keys, member).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    all_parts = Window.partitionBy(*keys)
    earlier = all_parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(all_parts).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(member))
    named = offsets.select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("_part").alias("_at"), "_before", "_n")
    placed = ranged.withColumn("_place", place).join(named, (F.col("_part") == F.col("_at")) & _same(keys))
    return _blocks(placed, F.col("_before") + F.col("_place"), F.col("_n"), keys, member, per_block)


def _blocks(placed: DataFrame, place, n, keys: list[str], member: str, per_block: int) -> DataFrame:
    block = F.floor((place - 1) / per_block).cast("long").alias("block")
    return placed.groupBy(*keys, block).agg(F.max(n).alias("n"), F.array_sort(F.collect_list(member)).alias("members"))


def blocks_with(blocks: DataFrame, value: str) -> DataFrame:
    """The block of each list that holds value, if one does: only blocks whose ends are round it are looked into."""
    around = (F.col("members")[0] <= value) & (F.element_at("members", -1) >= value)
    return blocks.filter(around & F.array_contains("members", value))
