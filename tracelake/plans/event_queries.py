"""Queries over event logs: lines of JSON in the view event_line, against SQL over the tables that they are made of."""

from pyspark.sql import functions as F

from ..operators import runs
from ..sources import files
from .bindings import view
from .registry import query


def _events(s, d):
    return files.parse_events(view(s, d, "event_line"))


_TOTALS = """SELECT l_suppkey, CAST(sum(CASE WHEN l_linenumber < 7 THEN l_partkey ELSE 0 END) AS BIGINT) AS input_bytes, CAST(sum(CASE WHEN l_linenumber < 7 THEN 2 * l_partkey ELSE 0 END) AS BIGINT) AS shuffle_read_bytes,
CAST(sum(CASE WHEN l_linenumber < 7 THEN l_suppkey ELSE 0 END) AS BIGINT) AS shuffle_write_bytes, CAST(sum(CASE WHEN l_linenumber < 7 THEN l_linenumber ELSE 0 END) AS BIGINT) AS spilled_bytes,
count(*) AS n_tasks, count(*) FILTER (l_orderkey % 13 = 0) AS n_failed_tasks FROM lineitem GROUP BY l_suppkey"""


@query(f"""SELECT CAST(s_suppkey AS VARCHAR) AS app, coalesce(input_bytes, 0) AS input_bytes, coalesce(shuffle_read_bytes, 0) AS shuffle_read_bytes, coalesce(shuffle_write_bytes, 0) AS shuffle_write_bytes, coalesce(spilled_bytes, 0) AS spilled_bytes,
3 AS n_jobs, (SELECT count(*) FROM region WHERE (s_suppkey + r_regionkey) % 4 <> 0) AS n_stages, coalesce(n_tasks, 0) AS n_tasks, coalesce(n_failed_tasks, 0) AS n_failed_tasks FROM supplier LEFT JOIN ({_TOTALS}) ON l_suppkey = s_suppkey""")
def event_totals(s, d):
    return runs.event_totals(_events(s, d))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS app, CASE WHEN s_suppkey % 2 = 0 THEN '2' END AS driver_cores, CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 2 = 0 THEN 'g' ELSE 'm' END AS executor_memory, CASE WHEN s_suppkey % 2 = 1 THEN '3' END AS executor_instances FROM supplier"""
)
def event_settings(s, d):
    return runs.event_config(_events(s, d)).select("app", "driver_cores", "executor_memory", "executor_instances")


_STAGES = """stages AS (SELECT s_suppkey, r_regionkey AS stage, 's' || r_regionkey AS name, s_suppkey % 9 AS n_tasks, (s_suppkey + r_regionkey) % 4 <> 0 AS done, (s_suppkey + r_regionkey) % 4 = 1 AS failed FROM supplier, region WHERE r_regionkey < 4)"""


@query(f"""WITH {_STAGES} SELECT CAST(s_suppkey AS VARCHAR) AS app, stage, name, n_tasks, CASE WHEN done THEN 'completed' ELSE 'submitted' END AS state, CASE WHEN done THEN s_suppkey END AS duration_ms, CASE WHEN done THEN s_suppkey % 3 ELSE 0 END AS n_failed_tasks,
CASE WHEN failed THEN 'boom' END AS failure, CASE WHEN done THEN s_suppkey * 5 END AS shuffle_write_bytes, CASE WHEN done THEN s_suppkey END AS input_bytes FROM stages""")
def event_stages(s, d):
    return runs.event_stages(_events(s, d)).select(
        "app",
        "stage",
        "name",
        "n_tasks",
        "state",
        "duration_ms",
        "n_failed_tasks",
        "failure",
        "shuffle_write_bytes",
        "input_bytes"
    )


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS app, r_regionkey AS job, 50 AS "start", '1,2' AS stages, 'job ' || s_suppkey AS description, CASE (s_suppkey + r_regionkey) % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'JobSucceeded' ELSE 'JobFailed' END AS state,
CASE WHEN (s_suppkey + r_regionkey) % 3 <> 0 THEN s_suppkey END AS duration_ms FROM supplier, region WHERE r_regionkey < 3""")
def event_jobs(s, d):
    return runs.event_jobs(_events(s, d)).select(
        "app",
        "job",
        "start",
        F.array_join(F.col("stages").cast("array<string>"), ",").alias("stages"),
        "description",
        "state",
        "duration_ms"
    )


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS app, CAST(n_nationkey AS VARCHAR) AS executor, 'h' || n_nationkey AS host, 4 AS cores, s_suppkey AS memory, CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE 8 END AS added, CASE WHEN gone THEN 99 END AS removed,
CASE WHEN gone THEN CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'lost' END END AS reason, CASE WHEN gone THEN 'removed' ELSE 'active' END AS status FROM (SELECT *, (s_suppkey + n_nationkey) % 2 = 0 AS gone FROM supplier, nation WHERE n_nationkey < 6)""")
def event_executors(s, d):
    return runs.event_executors(_events(s, d))


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS app, 'task' AS kind, l_orderkey AS id, l_linenumber AS stage, l_linenumber % 3 AS attempt, CASE WHEN l_orderkey % 26 = 0 THEN 'lost' ELSE 'java.io.IOException' END AS reason, CAST(l_orderkey % 5 AS VARCHAR) AS executor, 'h' || l_orderkey % 5 AS host, l_partkey AS duration FROM lineitem WHERE l_orderkey % 13 = 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'stage', r_regionkey, r_regionkey, NULL, 'boom', NULL, NULL, NULL FROM supplier, region WHERE (s_suppkey + r_regionkey) % 4 = 1
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'job', r_regionkey, NULL, NULL, 'JobFailed', NULL, NULL, NULL FROM supplier, region WHERE (s_suppkey + r_regionkey) % 3 = 2""")
def event_failures(s, d):
    return runs.event_failures(_events(s, d))


# Executors of an app from its log, the even ones as drivers of 10 MB each; peaks are half of the memory.
@query(f"""WITH e AS (SELECT s_suppkey, CASE WHEN n_nationkey = 0 THEN 'driver' ELSE CAST(n_nationkey AS VARCHAR) END AS executor, s_suppkey + n_nationkey AS mb, n_nationkey * 3 AS peak FROM supplier, nation WHERE n_nationkey < 6), {_STAGES},
a AS (SELECT s_suppkey, count(*) FILTER (executor <> 'driver') AS n_executors, CAST(sum(mb) FILTER (executor <> 'driver') AS BIGINT) AS total_memory_mb, max(peak) FILTER (executor <> 'driver') AS peak_memory_mb, max(mb) FILTER (executor = 'driver') AS driver_memory_mb FROM e GROUP BY s_suppkey),
b AS (SELECT s_suppkey, CAST(sum(CASE WHEN done THEN s_suppkey END) AS BIGINT) AS input_bytes, CAST(sum(CASE WHEN done THEN s_suppkey * 5 END) AS BIGINT) AS shuffle_write_bytes FROM stages GROUP BY s_suppkey)
SELECT CAST(s_suppkey AS VARCHAR) AS app, n_executors, total_memory_mb, peak_memory_mb, driver_memory_mb, input_bytes, shuffle_write_bytes FROM a JOIN b USING (s_suppkey)""")
def app_rollups(s, d):
    events = _events(s, d)
    number = F.col("executor").cast("long")
    e = runs.event_executors(events).select(
        "app",
        F.when(number == 0, "driver").otherwise(F.col("executor")).alias("executor"),
        (F.col("memory") + number).alias("max_memory_mb"),
        (number * 3).alias("peak_memory_mb")
    )
    zero = F.lit(0).cast("long")
    stages = runs.event_stages(events).select(
        "app",
        "input_bytes",
        "shuffle_write_bytes",
        zero.alias("shuffle_read_bytes"),
        zero.alias("spilled_bytes")
    )
    return runs.app_rollup(e, stages).select(
        "app",
        "n_executors",
        "total_memory_mb",
        "peak_memory_mb",
        "driver_memory_mb",
        "input_bytes",
        "shuffle_write_bytes"
    )


# The API knows the suppliers of even numbers and some that have no log; what a log says goes before it.
@query(
    f"""WITH t AS ({_TOTALS}), api AS (SELECT s_suppkey * 2 AS k, -1 AS v FROM supplier) SELECT CAST(coalesce(s_suppkey, k) AS VARCHAR) AS app, CASE WHEN s_suppkey IS NULL THEN -1 ELSE coalesce(input_bytes, 0) END AS input_bytes FROM (SELECT s_suppkey, input_bytes FROM supplier LEFT JOIN t ON l_suppkey = s_suppkey) e FULL JOIN api ON k = s_suppkey"""
)
def merged_metrics(s, d):
    api = view(s, d, "supplier").select((F.col("s_suppkey") * 2).cast("string").alias("app"), F.lit(-1).cast("long").alias("input_bytes"))
    return runs.merged_metrics(runs.event_totals(_events(s, d)), api, ("input_bytes",))
