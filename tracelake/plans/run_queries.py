"""Run, partition, alert and review queries over the supplied tables."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import alerts, partitions, review, runs
from ..sources import files
from .bindings import view
from .registry import query

J = lambda c: F.array_join(c, ",").alias(c)
R = lambda c: F.round(c, 6).alias(c)


@query(
    "SELECT id, project, workflow, state FROM instance WHERE start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-08' AND state = 'FAILURE' AND project = '2'"
)
def instance_list(s, d):
    return runs.by_state(view(s, d, "instance"), "2024-01-05", "2024-01-08", "FAILURE", "2").select("id", "project", "workflow", "state")


@query("SELECT id, project, workflow, state FROM instance WHERE start_time >= TIMESTAMP '2024-01-09' AND start_time < TIMESTAMP '2024-01-10'")
def instances_of_yesterday(s, d):
    a, b = runs.day_range("yesterday", F.lit("2024-01-10").cast("date"))
    return view(s, d, "instance").filter((F.col("start_time") >= a) & (F.col("start_time") < b)).select("id", "project", "workflow", "state")


@query("SELECT id, start_time, state FROM instance ORDER BY start_time DESC, id LIMIT 50")
def newest_instances(s, d):
    return runs.newest(view(s, d, "instance")).select("id", "start_time", "state")


_DAILY = """SELECT project, CAST(start_time AS DATE) AS day, count(*) AS total, count(*) FILTER (state = 'SUCCESS') AS success, count(*) FILTER (state = 'FAILURE') AS failure, count(*) FILTER (state = 'RUNNING') AS running,
round(avg(duration), 6) AS avg_duration, max(duration) AS max_duration, min(duration) AS min_duration, CAST(0 AS BIGINT) AS other, round(count(*) FILTER (state = 'SUCCESS') / count(*), 6) AS success_rate FROM instance {where} GROUP BY ALL"""


def _daily_cols():
    return ["project", "day", "total", "success", "failure", "running", R("avg_duration"), "max_duration", "min_duration", "other", R("success_rate")]


@query(_DAILY.format(where=""))
def daily_workflow_metrics(s, d):
    return runs.daily_workflow_metrics(view(s, d, "instance")).select(*_daily_cols())


@query(_DAILY.format(where="WHERE start_time >= TIMESTAMP '2024-01-10' AND start_time < TIMESTAMP '2024-01-13'"))
def range_report(s, d):
    return runs.range_report(view(s, d, "instance"), "2024-01-10", "2024-01-12").select(*_daily_cols())


@query(
    "SELECT project, CAST(start_time AS DATE) AS day, task_type, count(*) AS total, count(*) FILTER (state = 'FAILURE') AS failure, round(avg(duration), 6) AS avg_duration FROM instance GROUP BY ALL"
)
def daily_type_metrics(s, d):
    return runs.daily_type_metrics(view(s, d, "instance")).select("project", "day", "task_type", "total", "failure", R("avg_duration"))


@query("""SELECT project, CAST(start_time AS DATE) AS day, 'e' || retry AS error_type, count(*) AS n, string_agg(DISTINCT task_type, ',' ORDER BY task_type) AS task_types, array_to_string(list(id ORDER BY id)[1:3], ',') AS examples
FROM instance WHERE state <> 'SUCCESS' GROUP BY ALL""")
def daily_error_metrics(s, d):
    failures = view(s, d, "instance").filter("state != 'SUCCESS'").withColumn("error_type", F.concat(F.lit("e"), F.col("retry").cast("string")))
    return runs.daily_error_metrics(failures).select("project", "day", "error_type", "n", J("task_types"), J("examples"))


@query(
    "SELECT CAST(start_time AS DATE) AS day, count(*) FILTER (state = 'SUCCESS') AS success, count(*) FILTER (state = 'FAILURE') AS failure, count(*) FILTER (state = 'RUNNING') AS running FROM instance GROUP BY ALL"
)
def state_counts(s, d):
    return runs.state_counts(view(s, d, "instance"))


_DIST = """stats AS (SELECT app, stage, count(*) AS n_tasks, median(duration) FILTER (duration > 0) AS median_duration, max(duration) AS max_duration, list(input_bytes ORDER BY input_bytes)[1 + count(*) // 2] AS median_input FROM task_run GROUP BY ALL),
dist AS (SELECT s.*, max_duration / median_duration AS skew_ratio, coalesce(max_duration / median_duration > 3, false) AS is_skewed, n_stragglers, n_input_skewed FROM stats s JOIN
(SELECT app, stage, count(*) FILTER (r.duration > 3 * median_duration) AS n_stragglers, count(*) FILTER (r.input_bytes > 3 * median_input AND median_input > 0) AS n_input_skewed FROM task_run r JOIN stats USING (app, stage) GROUP BY ALL) USING (app, stage))"""


@query(
    "WITH " + _DIST + " SELECT app, stage, n_tasks, round(median_duration, 6) AS median_duration, max_duration, median_input, round(skew_ratio, 6) AS skew_ratio, is_skewed, n_stragglers, n_input_skewed FROM dist"
)
def task_distribution(s, d):
    return runs.task_distribution(view(s, d, "task_run")).select(
        "app",
        "stage",
        "n_tasks",
        R("median_duration"),
        "max_duration",
        "median_input",
        R("skew_ratio"),
        "is_skewed",
        "n_stragglers",
        "n_input_skewed"
    )


@query("WITH " + _DIST + """ SELECT app, bool_or(is_skewed) AS is_skewed, round(max(skew_ratio), 6) AS max_ratio, CAST(sum(n_input_skewed) AS BIGINT) AS n_input_skewed,
CASE WHEN NOT bool_or(is_skewed) THEN 'none' WHEN sum(n_input_skewed) > 0 THEN 'salting' ELSE 'parallelism' END AS advice FROM dist GROUP BY app""")
def app_skew(s, d):
    return runs.app_skew(runs.task_distribution(view(s, d, "task_run"))).select("app", "is_skewed", R("max_ratio"), "n_input_skewed", "advice")


@query("""SELECT workflow, count(*) AS n, round(avg(input_bytes_mb) FILTER (input_bytes_mb > 0), 6) AS avg_input_bytes_mb, CASE WHEN count(*) FILTER (input_bytes_mb > 0) > 1 THEN round(stddev_pop(input_bytes_mb) FILTER (input_bytes_mb > 0), 6) END AS std_input_bytes_mb,
round(avg(peak_memory_mb) FILTER (peak_memory_mb > 0), 6) AS avg_peak_memory_mb, CASE WHEN count(*) FILTER (peak_memory_mb > 0) > 1 THEN round(stddev_pop(peak_memory_mb) FILTER (peak_memory_mb > 0), 6) END AS std_peak_memory_mb
FROM (SELECT * FROM run_history WHERE success QUALIFY row_number() OVER (PARTITION BY workflow ORDER BY day DESC, run DESC) <= 5) GROUP BY workflow""")
def newest_baseline(s, d):
    return runs.newest_baseline(view(s, d, "run_history")).select(
        "workflow",
        "n",
        *(R(f"{k}_{m}") for m in ("input_bytes_mb", "peak_memory_mb") for k in ("avg", "std"))
    )


@query("""WITH ok AS (SELECT *, count(*) OVER (PARTITION BY workflow) AS n, row_number() OVER (PARTITION BY workflow ORDER BY input_bytes_mb, run) AS r FROM run_history WHERE success AND peak_memory_mb > 0),
a AS (SELECT workflow, count(*) AS n, avg(input_bytes_mb) AS d, avg(peak_memory_mb) AS p, avg(input_bytes_mb) FILTER (r <= n // 2) AS d0, avg(input_bytes_mb) FILTER (r > n // 2) AS d1, avg(peak_memory_mb) FILTER (r <= n // 2) AS p0, avg(peak_memory_mb) FILTER (r > n // 2) AS p1,
  avg(shuffle_read_mb + shuffle_write_mb) AS s, min(executor_memory_mb) AS m, min(executor_instances) AS i0, max(executor_instances) AS i1 FROM ok GROUP BY workflow),
b AS (SELECT *, CASE WHEN n >= 5 AND d1 > d0 THEN (p1 - p0) / (d1 - d0) ELSE p / d END AS slope FROM a)
SELECT workflow, n, CASE WHEN n < 3 OR d <= 0 THEN 'LOW' WHEN n >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, CASE WHEN n >= 3 AND d > 0 THEN round(slope, 6) END AS memory_per_data,
CASE WHEN n >= 3 AND d > 0 THEN greatest(CAST(trunc(10000 * slope * 1.3) AS BIGINT), m) END AS executor_memory_mb, CASE WHEN n >= 3 AND d > 0 THEN greatest(i0, least(greatest(2, CAST(trunc(10000 * s / d / 2048) AS BIGINT)), i1 * 2)) END AS executor_instances FROM b""")
def predicted_memory(s, d):
    return runs.predict_memory(view(s, d, "run_history"), F.lit(10000)).select(
        "workflow",
        "n",
        "confidence",
        R("memory_per_data"),
        "executor_memory_mb",
        "executor_instances"
    )


@query("""WITH needs AS (SELECT app AS key, CAST(sum(input_bytes) AS DOUBLE) AS shuffle_mb FROM task_run GROUP BY app), grid AS (SELECT mem, inst FROM (VALUES (512), (1024), (2048), (3072), (4096), (6144), (8192)) m(mem), range(2, 21) i(inst) WHERE NOT (mem <= 512 AND inst > 8 OR mem >= 6144 AND inst < 4)),
tried AS (SELECT key, shuffle_mb, mem, inst, mem * inst / shuffle_mb AS ratio FROM needs, grid WHERE shuffle_mb > 0 AND mem * inst / shuffle_mb BETWEEN 1.5 AND 2.5),
best AS (SELECT key, mem, inst FROM tried QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(abs(ratio - 1.5) - CASE WHEN inst BETWEEN 4 AND 12 THEN 0.1 ELSE 0 END, 9), mem, inst) = 1)
SELECT n.key, n.shuffle_mb, CAST(coalesce(mem, 4096) AS BIGINT) AS executor_memory_mb, CAST(coalesce(inst, greatest(2, least(20, trunc(shuffle_mb * 1.5 / 4096) + 1))) AS BIGINT) AS executor_instances FROM needs n LEFT JOIN best USING (key)""")
def balanced_config(s, d):
    needs = view(s, d, "task_run").groupBy(F.col("app").alias("key")).agg(F.sum("input_bytes").cast("double").alias("shuffle_mb"))
    return runs.balanced_config(needs)


@query("""WITH x AS (SELECT app, stage, sum(input_bytes) AS shuffle_mb, max(duration) // 50 AS peak_mb, count(*) % 3 AS spilled_mb FROM task_run GROUP BY ALL)
SELECT app, stage, CASE WHEN 2048.0 / shuffle_mb < 1 THEN 'risky' WHEN 2048.0 / shuffle_mb < 1.5 THEN 'need_increase' WHEN 2048.0 / shuffle_mb <= 2 THEN 'optimal' WHEN 2048.0 / shuffle_mb <= 3 THEN 'slightly_over' ELSE 'over_configured' END AS status,
CAST(least(16384, CASE WHEN spilled_mb > 0 THEN 4096 + spilled_mb WHEN peak_mb > 0 THEN trunc(peak_mb * 1.3) ELSE greatest(trunc(shuffle_mb / 4 * 1.5), 8192) END) AS BIGINT) AS executor_mb,
CASE WHEN spilled_mb > 0 THEN 'oom_spill' WHEN peak_mb > 0 THEN 'peak_memory' ELSE 'shuffle_based' END AS method, CAST(least(8192, CASE WHEN spilled_mb > 0 THEN 1024 + spilled_mb ELSE 2048 END) AS BIGINT) AS driver_mb,
CASE WHEN shuffle_mb * 10 >= 2048 AND least(greatest(2, shuffle_mb * 10 // 2048), 8, 100) > 4 THEN CAST(least(greatest(2, shuffle_mb * 10 // 2048), 8, 100) AS BIGINT) END AS instances FROM x""")
def size_suggestions(s, d):
    x = view(s, d, "task_run").groupBy("app", "stage").agg(
        F.sum("input_bytes").alias("shuffle"),
        F.floor(F.max("duration") / 50).alias("peak"),
        (F.count("*") % 3).alias("spilled")
    )
    c = F.col
    memory = runs.executor_memory(F.lit(4096), F.lit(None).cast("long"), c("spilled"), c("peak"), c("shuffle"), F.lit(4))
    return x.select(
        "app",
        "stage",
        runs.memory_use_status(F.lit(2048.0), c("shuffle")).alias("status"),
        memory.mb.cast("long").alias("executor_mb"),
        memory.method.alias("method"),
        runs.driver_memory(F.lit(1024), c("spilled")).cast("long").alias("driver_mb"),
        runs.executor_instances(F.lit(4), c("shuffle") * 10).alias("instances")
    )


_TIMEOUT = """t AS (SELECT workflow, id AS name, CAST(id AS BIGINT) AS ord, retry, CAST(duration * 3 AS BIGINT) AS wait, duration FROM instance),
m AS (SELECT workflow, max(retry) AS max_retry, arg_max(name, (retry, -ord)) AS retry_task, max(retry * 60) AS retry_time, max(duration) AS max_duration, arg_max(name, (duration, -ord)) AS slowest_task, max(wait) AS max_wait, avg(duration) AS avg_duration, avg(wait) AS avg_wait FROM t GROUP BY workflow)"""


def _timeouts(s, d):
    t = view(s, d, "instance").select(
        "workflow",
        F.col("id").alias("name"),
        F.col("id").cast("long").alias("ord"),
        F.col("retry").alias("retry_count"),
        F.lit(60).alias("retry_interval"),
        F.rint(F.col("duration") * 3).cast("long").alias("queue_wait"),
        F.lit(1).alias("data_size"),
        "duration"
    )
    return runs.timeout_metrics(
        t,
        t.groupBy("workflow").agg(F.avg("duration").alias("avg_duration"), F.lit(1e9).alias("avg_data"), F.avg("queue_wait").alias("avg_wait"))
    )


@query(
    "WITH " + _TIMEOUT + " SELECT workflow, max_retry, retry_task, CAST(retry_time AS BIGINT) AS retry_time, max_duration, slowest_task, max_wait, max_duration > 2 * avg_duration AS is_slow FROM m"
)
def timeout_metrics(s, d):
    return _timeouts(s, d).select(
        "workflow",
        "max_retry",
        "retry_task",
        F.col("retry_time").cast("long").alias("retry_time"),
        "max_duration",
        "slowest_task",
        "max_wait",
        "is_slow"
    )


# Metrics for each event such that every rule is the first to hold for some, and none for others.
_METRICS = """m AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 90.0 ELSE 50.0 END AS util, event_id % 110 AS containers, CASE WHEN event_id % 7 = 0 THEN 95.0 ELSE 60.0 END AS queue_used, event_id % 12 AS apps, event_id % 4 AS max_retry,
CASE WHEN event_id % 5 = 0 THEN 400.0 ELSE 100.0 END AS max_wait, event_id % 300 AS avg_wait, event_id % 900 AS max_duration, event_id % 200 AS avg_duration, event_id % 13 = 1 AS is_data_spike, event_id % 3 = 1 AS upstream_delay, event_id % 30 AS running FROM events)"""


@query("WITH " + _METRICS + """, k AS (SELECT *, CASE WHEN util > 85 THEN 1 WHEN containers > 100 THEN 2 WHEN queue_used > 90 THEN 3 WHEN apps > 10 THEN 4 WHEN max_retry >= 3 THEN 5 WHEN max_wait > 300 AND max_wait / greatest(avg_wait, 1) > 2 THEN 6
WHEN max_duration / greatest(avg_duration, 1) > 3 THEN 7 WHEN is_data_spike THEN 8 WHEN upstream_delay THEN 9 ELSE 10 END AS r FROM m)
SELECT event_id, ['cluster_overloaded', 'cluster_overloaded', 'queue_congested', 'queue_congested', 'task_retry_timeout', 'queue_wait_long', 'task_execution_slow', 'data_volume_spike', 'upstream_delay', 'unknown'][r] AS timeout_type,
CASE WHEN r < 5 THEN 'RESOURCE_SUGGESTED' WHEN r < 10 THEN 'KNOWN_NEEDS_LLM' ELSE 'UNKNOWN' END AS category, [0.85, 0.8, 0.8, 0.75, 0.9, 0.85, 0.8, 0.7, 0.65, 0.0][r]::DOUBLE AS confidence,
CASE WHEN r < 3 THEN 'reduce_concurrency ' || greatest(5, 20 - running) WHEN r < 5 THEN 'adjust_queue_capacity +20%' END AS advice FROM k""")
def timeout_classes(s, d):
    e = F.col("event_id")
    m = view(s, d, "events").select(
        e, F.when(e % 11 == 0, 90.0).otherwise(50.0).alias("util"), (e % 110).alias("containers"), F.when(e % 7 == 0, 95.0).otherwise(60.0).alias("queue_used"), (e % 12).alias("apps"), (e % 4).alias("max_retry"), F.when(e % 5 == 0, 400.0).otherwise(100.0).alias("max_wait"),
        (e % 300).alias("avg_wait"), (e % 900).alias("max_duration"), (e % 200).alias("avg_duration"), (e % 13 == 1).alias("is_data_spike"), (e % 3 == 1).alias("upstream_delay"), (e % 30).alias("running"),
    )
    return runs.timeout_advice(runs.timeout_class(m)).select("event_id", "timeout_type", "category", "confidence", "advice")


@query("""WITH x AS (SELECT event_id AS id, 1000 AS total_memory_mb, event_id % 1000 AS used_memory_mb, 100 AS total_vcores, event_id % 100 AS used_vcores, 10 - event_id % 4 AS active_nodes, event_id % 4 AS unhealthy_nodes, event_id % 150 AS pending_containers FROM events),
y AS (SELECT id, round(used_memory_mb * 100.0 / 1000, 2) AS memory_pct, round(used_vcores * 100.0 / 100, 2) AS vcore_pct, round(active_nodes * 100.0 / 10, 2) AS health_pct, pending_containers FROM x)
SELECT id, CAST(memory_pct AS DOUBLE) AS memory_pct, CAST(vcore_pct AS DOUBLE) AS vcore_pct, CAST(health_pct AS DOUBLE) AS health_pct, concat_ws(',', CASE WHEN memory_pct > 85 THEN 'memory' END, CASE WHEN vcore_pct > 85 THEN 'vcores' END, CASE WHEN pending_containers > 100 THEN 'containers' END, CASE WHEN health_pct < 80 THEN 'nodes' END) AS reasons, NOT (memory_pct > 80 OR pending_containers > 10) AS is_safe FROM y""")
def cluster_status(s, d):
    e = F.col("event_id")
    x = view(s, d, "events").select(
        e.alias("id"),
        F.lit(1000).alias("total_memory_mb"),
        (e % 1000).alias("used_memory_mb"),
        F.lit(100).alias("total_vcores"),
        (e % 100).alias("used_vcores"),
        (10 - e % 4).alias("active_nodes"),
        (e % 4).alias("unhealthy_nodes"),
        (e % 150).alias("pending_containers")
    )
    out = runs.cluster_status(x)
    return out.select(
        "id",
        "memory_pct",
        "vcore_pct",
        "health_pct",
        J("reasons"),
        runs.is_safe(F.col("memory_pct"), F.col("pending_containers")).alias("is_safe")
    )


_HEALTH = """part AS (SELECT * FROM partition_stat WHERE (date_part('day', day) + length(table_name)) % 6 <> 0),
days AS (SELECT table_name, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM (SELECT table_name, min(day)::TIMESTAMP AS a, max(day)::TIMESTAMP AS b FROM part GROUP BY table_name)),
dense AS (SELECT table_name, day, p.file_count IS NOT NULL AS present, coalesce(p.file_count, 0) AS file_count, coalesce(p.total_size, 0) AS total_size, CASE WHEN p.file_count > 0 THEN p.file_count END AS fc, CASE WHEN p.file_count > 0 THEN p.total_size END AS ts FROM days LEFT JOIN part p USING (table_name, day)),
base AS (SELECT *, avg(fc) OVER w AS avg_count, coalesce(stddev_pop(fc) OVER w, 0) AS std_count, min(fc) OVER w AS min_count, avg(ts) OVER w AS avg_size, count(fc) OVER w AS n_history FROM dense WINDOW w AS (PARTITION BY table_name ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))"""


def _parts(s, d):
    return view(s, d, "partition_stat").filter((F.dayofmonth("day") + F.length("table_name")) % 6 != 0)


@query(
    "WITH " + _HEALTH + " SELECT table_name, day, present AS \"exists\", file_count, round(avg_count, 6) AS avg_count, round(std_count, 6) AS std_count, n_history FROM base"
)
def partition_baseline(s, d):
    return partitions.with_baseline(partitions.densified(_parts(s, d))).select(
        "table_name",
        "day",
        "exists",
        "file_count",
        R("avg_count"),
        R("std_count"),
        "n_history"
    )


@query("WITH " + _HEALTH + """, y AS (SELECT *, present AND n_history > 0 AS k FROM base), z AS (SELECT *, concat_ws(',', CASE WHEN NOT present THEN 'PARTITION_MISSING' END, CASE WHEN present AND n_history = 0 THEN 'NO_HISTORY_DATA' END, CASE WHEN k AND file_count < 0.5 * min_count THEN 'FILE_COUNT_LOW' END,
CASE WHEN k AND NOT file_count < 0.5 * min_count AND file_count < avg_count - 2 * std_count THEN 'FILE_COUNT_BELOW_AVG' END, CASE WHEN k AND total_size < 0.3 * avg_size THEN 'TOTAL_SIZE_LOW' END, CASE WHEN k AND NOT total_size < 0.3 * avg_size AND total_size < 0.5 * avg_size THEN 'TOTAL_SIZE_BELOW_AVG' END,
CASE WHEN k AND total_size / file_count < 1024 THEN 'AVG_FILE_SIZE_SMALL' END) AS anomalies FROM y)
SELECT table_name, day, anomalies, CASE WHEN anomalies LIKE '%MISSING%' THEN 'CRITICAL' WHEN anomalies LIKE '%LOW%' AND anomalies <> 'X' THEN 'HIGH' WHEN anomalies LIKE '%BELOW%' OR anomalies LIKE '%SMALL%' THEN 'MEDIUM' WHEN anomalies <> '' THEN 'LOW' ELSE 'NONE' END AS severity FROM z""".replace("LIKE '%LOW%' AND anomalies <> 'X'", "SIMILAR TO '.*(COUNT|SIZE)_LOW.*'"))
def partition_health(s, d):
    return partitions.health(_parts(s, d)).select("table_name", "day", J("anomalies"), "severity")


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE (SELECT CAST(ts AS DATE) FROM events e WHERE e.event_id = p.event_id) END AS day, CASE event_id % 4 WHEN 0 THEN 'dt' END AS key,
CASE event_id % 4 WHEN 3 THEN path ELSE regexp_extract(path, '^(/user/hive/warehouse/db.db/[a-z]+)', 1) END AS base FROM storage_path p""")
def path_dates(s, d):
    p = F.col("path")
    return view(s, d, "storage_path").select(
        "event_id",
        text.partition_date(p).alias("day"),
        text.partition_key(p).alias("key"),
        text.partition_base(p).alias("base")
    )


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'INVALID_PATH' WHEN s.file_count IS NULL THEN 'missing' WHEN s.file_count = 0 THEN 'empty' ELSE 'exists' END AS status FROM storage_path p JOIN events e USING (event_id)
LEFT JOIN (SELECT * FROM partition_stat WHERE (date_part('day', day) + length(table_name)) % 6 <> 0) s ON s.table_name = e.event_type AND s.day = CAST(e.ts AS DATE)""")
def path_checks(s, d):
    stats = _parts(s, d).withColumn("table_name", F.concat(F.lit("/user/hive/warehouse/db.db/"), F.col("table_name")))
    return partitions.check_paths(view(s, d, "storage_path"), stats).select("event_id", "status")


@query(
    """SELECT regexp_extract(path, '^(/user/hive/warehouse/db.db/[a-z]+)', 1) AS table_name, CAST(ts AS DATE) AS day, count(*) AS file_count, CAST(sum(100 + event_id) AS BIGINT) AS total_size FROM storage_path JOIN events USING (event_id) WHERE event_id % 4 <> 3 GROUP BY ALL"""
)
def partition_listing(s, d):
    listing = view(s, d, "storage_path").filter("event_id % 4 != 3").withColumn("length", F.col("event_id") + 100)
    return partitions.partition_stats(listing)


# The first failure up to six hours around each signup of the next user.
@query("""WITH a AS (SELECT event_id AS alert_id, CAST(user_id % 5 AS VARCHAR) AS project, CAST(user_id AS VARCHAR) AS upstream, ts FROM events WHERE event_type = 'signup')
SELECT alert_id, id AS instance_id, start_time FROM a JOIN instance i ON i.project = a.project AND i.workflow = a.upstream AND i.state = 'FAILURE' AND abs(epoch(date_trunc('second', i.start_time)) - epoch(date_trunc('second', a.ts))) <= 21600 QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY start_time, id) = 1""")
def upstream_failures(s, d):
    a = view(s, d, "events").filter("event_type = 'signup'").select(
        F.col("event_id").alias("alert_id"),
        (F.col("user_id") % 5).cast("string").alias("project"),
        F.col("user_id").cast("string").alias("upstream"),
        "ts"
    )
    return alerts.upstream_failures(a, view(s, d, "instance"))


@query(
    "SELECT project, workflow, id, start_time FROM instance QUALIFY row_number() OVER (PARTITION BY project, workflow ORDER BY start_time DESC, id DESC) = 1"
)
def latest_instances(s, d):
    return alerts.latest_instances(view(s, d, "instance"))


def _actions(s, d):
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("rerun", "recover-failed", "delete", "edit"))), (e % 4 + 1).cast("int"))
    return view(s, d, "events").select(
        (e % 997).alias("alert_id"),
        kind.alias("action_type"),
        (e % 11 == 0).alias("structural"),
        (e % 7 == 0).alias("multi_param"),
        (e % 6).alias("retry_count"),
        (e % 9).alias("n_downstream")
    ).filter("action_type != 'delete' OR alert_id % 5 = 0")


@query("""WITH x AS (SELECT event_id % 997 AS alert_id, CASE event_id % 4 WHEN 0 THEN 'rerun' WHEN 1 THEN 'recover-failed' WHEN 2 THEN 'delete' ELSE 'edit' END AS action, event_id AS e FROM events),
r AS (SELECT alert_id, max(CASE WHEN action = 'delete' THEN 3 WHEN (action = 'recover-failed' AND e % 9 > 5) OR e % 11 = 0 THEN 2 WHEN e % 7 = 0 OR (action = 'rerun' AND e % 6 > 3) OR (action = 'recover-failed' AND e % 9 >= 1) THEN 1 ELSE 0 END) AS r FROM x WHERE action <> 'delete' OR alert_id % 5 = 0 GROUP BY alert_id)
SELECT alert_id, CASE r WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk, r >= 2 AS needs_approval FROM r""")
def alert_risks(s, d):
    return alerts.alert_risk(_actions(s, d))


@query("""WITH x AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT CAST(f.user_id AS VARCHAR) AS "user", f.event_id AS feedback_id, (SELECT CASE WHEN epoch_us(f.ts) - epoch_us(max(e.ts)) <= 18000000000 THEN CAST(arg_max(e.event_id, e.ts) AS VARCHAR) END FROM x e WHERE e.event_type = 'purchase' AND e.user_id = f.user_id AND e.ts <= f.ts) AS execution_id FROM x f WHERE f.event_type = 'signup'""")
def feedback_matches(s, d):
    e = view(s, d, "events").withColumn("user", F.col("user_id").cast("string"))
    f = e.filter("event_type = 'signup'").select("user", "ts", F.col("event_id").alias("feedback_id"))
    return alerts.feedback_matches(f, e.filter("event_type = 'purchase'").select("user", "ts", F.col("event_id").alias("execution_id")), 300 * 60)


@query("""WITH r AS (SELECT event_id AS request_id, user_id, ts AS created_at, ts + INTERVAL 30 HOUR AS expires_at FROM events WHERE event_type = 'view'),
d AS (SELECT r.request_id, e.ts, CASE WHEN e.event_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM r JOIN events e ON e.user_id = r.user_id AND e.event_type = 'purchase' AND e.ts > r.created_at AND e.ts < r.created_at + INTERVAL 60 HOUR)
SELECT request_id, coalesce((SELECT arg_min(status, ts) FROM d WHERE d.request_id = r.request_id AND d.ts <= r.expires_at), CASE WHEN TIMESTAMP '2024-01-30' > expires_at THEN 'timeout' ELSE 'pending' END) AS status FROM r""")
def approval_states(s, d):
    e = view(s, d, "events")
    r = e.filter("event_type = 'view'").select(
        F.col("event_id").alias("request_id"),
        "user_id",
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("INTERVAL 30 HOURS")).alias("expires_at")
    )
    p = e.filter("event_type = 'purchase'").select(
        "user_id",
        "ts",
        F.when(F.col("event_id") % 2 == 0, "approved").otherwise("rejected").alias("status")
    )
    decisions = r.join(p, "user_id").filter("ts > created_at AND ts < created_at + INTERVAL 60 HOURS").select("request_id", "ts", "status")
    return alerts.approvals_at(r, decisions, F.lit("2024-01-30").cast("timestamp_ntz"))


@query("SELECT min(doc_id) AS doc_id, skill_name, md5(original_log) AS log_md5 FROM candidate GROUP BY skill_name, original_log")
def first_candidates(s, d):
    return review.first_candidates(view(s, d, "candidate")).select("doc_id", "skill_name", F.md5("original_log").alias("log_md5"))


@query(
    "SELECT skill_name, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'pending') AS pending FROM candidate GROUP BY skill_name"
)
def candidate_counts(s, d):
    return review.status_counts(view(s, d, "candidate"))


@query("SELECT doc_id, skill_name FROM candidate WHERE status = 'pending'")
def pending_candidates(s, d):
    return review.pending(view(s, d, "candidate")).select("doc_id", "skill_name")


@query("SELECT doc_id, skill_name, status FROM candidate WHERE status <> 'approved'")
def kept_candidates(s, d):
    return review.without_approved(view(s, d, "candidate")).select("doc_id", "skill_name", "status")


@query(
    "SELECT c.doc_id, CASE WHEN e.event_id IS NULL THEN c.status WHEN e.event_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM candidate c LEFT JOIN (SELECT * FROM events WHERE event_id % 3 = 0) e ON e.event_id = c.doc_id"
)
def reviewed_candidates(s, d):
    decisions = view(s, d, "events").filter("event_id % 3 = 0").select(
        F.col("event_id").alias("candidate_id"),
        F.when(F.col("event_id") % 2 == 0, "approved").otherwise("rejected").alias("status"),
        F.lit("x").alias("reviewed_by"),
        F.col("ts").alias("reviewed_at"),
        F.lit("").alias("note")
    )
    return review.reviewed(view(s, d, "candidate").withColumn("candidate_id", F.col("doc_id")), decisions).select("doc_id", "status")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN status WHEN doc_id % 3 = 0 THEN 'confirmed' WHEN doc_id % 3 = 1 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN doc_id % 4 >= 2 AND doc_id % 3 = 1 THEN 'see notes' END AS correction FROM candidate"""
)
def confirmed_knowledge(s, d):
    k = view(s, d, "candidate").select("doc_id", F.col("doc_id").alias("id"), "status")
    fb = k.filter("id % 3 != 2").select(
        "id",
        F.when(F.col("id") % 3 == 0, "valid").otherwise("invalid").alias("feedback"),
        F.lit("see notes").alias("suggestion"),
        F.lit(1).alias("at")
    )
    return review.confirm(k, fb).select("doc_id", "status", "correction")


@query("""SELECT p.project, p.nodes, p.n_nodes, coalesce(e.n_edges, 0) AS n_edges, coalesce(e.edges, '') AS edges, coalesce(t.n_tasks, 0) AS n_tasks FROM (SELECT project, string_agg(code, ',' ORDER BY code) AS nodes, count(*) AS n_nodes FROM workflow GROUP BY project) p
LEFT JOIN (SELECT project, count(*) AS n_edges, string_agg(source || '>' || target, ',' ORDER BY source, target) AS edges FROM calls GROUP BY project) e USING (project) LEFT JOIN (SELECT project, count(*) AS n_tasks FROM task GROUP BY project) t USING (project)""")
def graph_export(s, d):
    out = files.graph_export(view(s, d, "workflow"), view(s, d, "calls"), view(s, d, "task"))
    edges = F.array_join(F.transform("edges", lambda e: F.concat_ws(">", e.source, e.target)), ",")
    return out.select("project", J("nodes"), "n_nodes", "n_edges", F.coalesce(edges, F.lit("")).alias("edges"), "n_tasks")


@query("SELECT DISTINCT project FROM workflow")
def project_list(s, d):
    return files.projects(view(s, d, "workflow"))


_BLOCKS = "b AS (SELECT CAST(l_suppkey AS VARCHAR) AS app, l_linenumber AS rdd, CAST(l_orderkey % 10 AS VARCHAR) AS executor, l_quantity AS memory_mb, CASE WHEN l_orderkey % 11 = 0 THEN l_tax ELSE 0 END AS disk_mb FROM lineitem)"


def _blocks(s, d):
    li = view(s, d, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("string").alias("app"),
        F.col("l_linenumber").alias("rdd"),
        (F.col("l_orderkey") % 10).cast("string").alias("executor"),
        F.col("l_quantity").alias("memory_mb"),
        F.when(F.col("l_orderkey") % 11 == 0, F.col("l_tax")).otherwise(0).alias("disk_mb")
    )


@query(
    "WITH " + _BLOCKS + " SELECT app, rdd, count(DISTINCT executor) AS n_executors, median(memory_mb) AS median_mb, max(memory_mb) AS max_mb, round(max(memory_mb) / median(memory_mb), 6) AS ratio, count(DISTINCT executor) >= 2 AND max(memory_mb) / median(memory_mb) > 1.9 AS is_skewed FROM b GROUP BY ALL"
)
def cached_skew(s, d):
    return runs.cached_skew(_blocks(s, d), 1.9).select("app", "rdd", "n_executors", "median_mb", "max_mb", R("ratio"), "is_skewed")


@query(
    "WITH " + _BLOCKS + " SELECT app, count(*) AS n_rdds, sum(memory_mb) AS memory_mb, round(sum(disk_mb), 6) AS disk_mb, sum(disk_mb) > 0 AS spills, CASE WHEN sum(memory_mb) > 4096 THEN 'HIGH' WHEN sum(memory_mb) > 2048 THEN 'MEDIUM' ELSE 'LOW' END AS oom_risk FROM b GROUP BY app"
)
def cached_totals(s, d):
    return runs.cached_totals(_blocks(s, d)).select("app", "n_rdds", "memory_mb", R("disk_mb"), "spills", "oom_risk")


@query(
    "SELECT source AS workflow_code, count(*) AS n_reports, CAST(sum(n_chars // 4) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS log_chars FROM documents GROUP BY source"
)
def report_totals(s, d):
    r = view(s, d, "documents").select(
        F.col("source").alias("workflow_code"),
        F.floor(F.col("n_chars") / 4).alias("tokens"),
        F.col("text").alias("log_text")
    )
    return runs.report_totals(r)


@query(
    "WITH " + _TIMEOUT + " SELECT workflow, CASE WHEN max_retry > 3 THEN 'retry' WHEN max_wait > 2 * avg_wait THEN 'queue_wait' ELSE 'unknown' END AS cause FROM m"
)
def timeout_causes(s, d):
    return runs.simple_timeout_cause(
        _timeouts(s, d).withColumn("max_retry", F.greatest(F.col("max_retry") - 3, F.lit(0)))
    ).select("workflow", "cause")


@query(
    "SELECT workflow, run, round(greatest(greatest(0.6 * input_bytes_mb / 1024, executor_memory_mb / 1024) * CASE WHEN run % 2 = 0 THEN 1.5 ELSE 1 END + 0.3 * shuffle_read_mb / 1024, 1.5 * executor_memory_mb / 1024), 6) AS need_gb FROM run_history"
)
def data_driven_sizes(s, d):
    c = lambda x: F.col(x) / 1024
    need = runs.sized_by_data(c("input_bytes_mb"), c("executor_memory_mb"), F.col("run") % 2 == 0, c("shuffle_read_mb"))
    return view(s, d, "run_history").select("workflow", "run", F.round(need, 6).alias("need_gb"))
