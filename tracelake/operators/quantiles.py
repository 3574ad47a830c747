"""Exact order statistics of groups from counts of values, without gathering a group anywhere.

The state of a group is how often it has each value: counts add up, so that days can be kept apart and merged. A rank is
found in two steps for all groups at once: first the bin of values that holds it, by the counts of some thousands of
bins, then the value in that bin. Only the counts of the bin that was hit are looked at again.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of values between a power of two and the next.
PER_OCTAVE = 128


def value_counts(rows: DataFrame, keys: list[str], value: Column | str) -> DataFrame:
    """keys, value, n: how often each value occurs in a group; nulls are values, too."""
    column = F.col(value) if isinstance(value, str) else value
    return rows.select(*keys, column.alias("value")).groupBy(*keys, "value").agg(F.count("*").alias("n"))


def merged_counts(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The counts of all parts together, such as those of several days."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def _bin(value: Column) -> Column:
    """Grows with value, by 128 steps for each power of two in either direction."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value.cast("double")) + 1) * PER_OCTAVE)).cast("int")


def at_ranks(counts: DataFrame, keys: list[str], ranks: DataFrame, few: bool = False) -> DataFrame:
    """keys, name, value: the value at each rank (keys, name, rank; from 0) of its group's values in order, nulls left
    out; ranks beyond the values give no row. few: whether the ranks have been counted to be few enough to be broadcast."""
    binned = counts.filter("value IS NOT NULL").withColumn("_bin", _bin(F.col("value")))
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n"))
    hit = ranks.join(bins, keys).filter(inside).select(*keys, "name", "_bin", (F.col("rank") - F.col("_before")).alias("_rank"))
    upto = Window.partitionBy(*keys, "name", "_bin").orderBy("value")
    found = binned.join(F.broadcast(hit) if few else hit, [*keys, "_bin"]).withColumn("_upto", F.sum("n").over(upto)).filter(F.col("_upto") > F.col("_rank"))
    return found.groupBy(*keys, "name").agg(F.min("value").alias("value"))


def quantiles(counts: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """keys and a column for each of shares: the quantile between the two values next to it, as percentile() gives it."""
    n = counts.filter("value IS NOT NULL").groupBy(*keys).agg(F.sum("n").alias("_n"))
    wanted = [F.struct(F.lit(k).alias("q"), ((F.col("_n") - 1) * F.lit(float(s))).alias("at")) for k, s in shares.items()]
    places = n.select(*keys, F.explode(F.array(*wanted)).alias("w")).select(*keys, "w.q", "w.at")
    sides = F.array(*(F.struct(F.concat("q", F.lit(f"_{side}")).alias("name"), f("at").cast("long").alias("rank")) for side, f in (("low", F.floor), ("high", F.ceil))))
    ranks = places.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.name", "s.rank")
    found = at_ranks(counts, keys, ranks)
    by = {f"{k}_{side}": F.max(F.when(F.col("name") == f"{k}_{side}", F.col("value").cast("double"))) for k in shares for side in ("low", "high")}
    out = n.join(found.groupBy(*keys).agg(*(c.alias(f"_{k}") for k, c in by.items())), keys)
    rest = {k: (F.col("_n") - 1) * F.lit(float(s)) - F.floor((F.col("_n") - 1) * F.lit(float(s))) for k, s in shares.items()}
    return out.select(*keys, *((F.col(f"_{k}_low") + (F.col(f"_{k}_high") - F.col(f"_{k}_low")) * rest[k]).alias(k) for k in shares))
