"""Health of stored partitions against their own history. Columns: table_name, day, file_count, total_size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import partition_base, partition_date


def partition_stats(listing: DataFrame) -> DataFrame:
    """Files and bytes by table and day of a listing (path, length); only data files count."""
    data = listing.filter(F.lower("path").rlike(r"\.(parquet|csv|json|txt|orc|avro|snappy|gz)$"))
    return data.groupBy(
        partition_base(F.col("path")).alias("table_name"),
        partition_date(F.col("path")).alias("day")
    ).agg(F.count("*").alias("file_count"), F.sum("length").alias("total_size"))


def densified(stats: DataFrame) -> DataFrame:
    """A row for each day between a table's first and last, with whether the partition exists."""
    span = stats.groupBy("table_name").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select("table_name", F.explode(F.sequence("a", "b")).alias("day"))
    out = days.join(stats, ["table_name", "day"], "left")
    return out.withColumn("exists", F.col("file_count").isNotNull()).fillna(0, ["file_count", "total_size"])


def with_baseline(stats: DataFrame, days: int = 7) -> DataFrame:
    """stats with mean, population deviation, least, greatest and number of the existing, non-empty partitions of the
    days before."""
    n = F.datediff("day", F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy("table_name").orderBy("_n").rangeBetween(-days, -1)
    out = stats.withColumn("_n", n)
    for c, short in (("file_count", "count"), ("total_size", "size")):
        v = F.when(F.col("file_count") > 0, F.col(c))
        out = out.withColumn(f"avg_{short}", F.avg(v).over(before)).withColumn(
            f"std_{short}",
            F.coalesce(F.stddev_pop(v).over(before), F.lit(0.0))
        ).withColumn(f"min_{short}", F.min(v).over(before)).withColumn(f"max_{short}", F.max(v).over(before))
    return out.withColumn("n_history", F.count(F.when(F.col("file_count") > 0, 1)).over(before)).drop("_n")


def anomalies(stats: DataFrame) -> DataFrame:
    """stats (with baseline and exists) with the list of rules that a partition breaks, their severity and advice."""
    c = F.col
    present, known = c("exists"), c("n_history") > 0
    size = F.try_divide(c("total_size"), c("file_count"))
    rules = [
        ("PARTITION_MISSING", 4, ~present),
        ("NO_HISTORY_DATA", 1, present & ~known),
        ("FILE_COUNT_LOW", 3, present & known & (c("file_count") < 0.5 * c("min_count"))),
        ("FILE_COUNT_BELOW_AVG", 2, present & known & ~(c("file_count") < 0.5 * c("min_count")) & (c("file_count") < c("avg_count") - 2 * c("std_count"))),
        ("TOTAL_SIZE_LOW", 3, present & known & (c("total_size") < 0.3 * c("avg_size"))),
        ("TOTAL_SIZE_BELOW_AVG", 2, present & known & ~(c("total_size") < 0.3 * c("avg_size")) & (c("total_size") < 0.5 * c("avg_size"))),
        ("AVG_FILE_SIZE_SMALL", 2, present & known & (size < 1024)),
    ]
    out = stats.withColumn("anomalies", F.array_compact(F.array(*(F.when(h, name) for name, _, h in rules))))
    worst = F.greatest(*(F.when(h, rank).otherwise(0) for _, rank, h in rules))
    has = lambda x: F.array_contains("anomalies", x)
    severity = F.when(worst == 4, "CRITICAL").when(worst == 3, "HIGH").when(worst == 2, "MEDIUM").when(worst == 1, "LOW").otherwise("NONE")
    advice = F.when(has("PARTITION_MISSING"), "check the upstream job").when(has("NO_HISTORY_DATA"), "collect history first").when(
        has("FILE_COUNT_LOW") | has("TOTAL_SIZE_LOW"),
        "check whether the data is complete"
    ).when(F.size("anomalies") > 0, "watch the partition").otherwise("none")
    return out.withColumn("severity", severity).withColumn("advice", advice)


def health(stats: DataFrame) -> DataFrame:
    """Every table and day from the first to the last: missing days show as missing."""
    return anomalies(with_baseline(densified(stats)))


def check_paths(paths: DataFrame, stats: DataFrame) -> DataFrame:
    """paths (key, path) against partitions: exists, empty, missing, or INVALID_PATH without a date."""
    keyed = paths.withColumn("table_name", partition_base(F.col("path"))).withColumn("day", partition_date(F.col("path")))
    out = keyed.join(stats.select("table_name", "day", "file_count"), ["table_name", "day"], "left")
    return out.withColumn(
        "status",
        F.when(F.col("day").isNull(), "INVALID_PATH").when(F.col("file_count").isNull(), "missing").when(F.col("file_count") == 0, "empty").otherwise("exists")
    )
