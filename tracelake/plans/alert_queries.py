"""Queries over messages, commands, feedback and errors made from the events, one form of each after the other."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import alerts
from .bindings import view
from .registry import query


def _listed(i, values):
    """The value whose number is i modulo their count."""
    return F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# By number modulo 10: whether the message is an alert, and how many alerts it holds.
@query("""SELECT event_id, event_id % 10 IN (0, 1, 2, 3, 4, 6) AS is_alert, event_id % 10 IN (0, 1, 3, 5, 9) AS is_request FROM events""")
def alert_messages(s, d):
    m = view(s, d, "message")
    # A list isn't a request: of numbers 1 and 5 the first object is asked about.
    return m.select(
        "event_id",
        alerts.is_alert(F.col("raw")).alias("is_alert"),
        alerts.is_request(F.regexp_replace("raw", r"^\[(\{.*?\}).*\]$", "$1")).alias("is_request")
    )


@query("""WITH x AS (SELECT event_id AS e, user_id AS u FROM events)
SELECT e AS event_id, CAST(u AS VARCHAR) AS project_code, NULL AS workflow_code, NULL AS task_instance_id, 'SPARK' AS task_type, NULL AS workflow_name, false AS is_sub_workflow FROM x WHERE e % 10 = 0
UNION ALL SELECT e, NULL, CAST(u AS VARCHAR), NULL, 'SHELL', NULL, false FROM x WHERE e % 10 = 1
UNION ALL SELECT e, CAST(u + 1 AS VARCHAR), NULL, NULL, 'SHELL', NULL, false FROM x WHERE e % 10 = 1
UNION ALL SELECT e, CAST(u AS VARCHAR), NULL, '77', 'SHELL', NULL, false FROM x WHERE e % 10 = 2
UNION ALL SELECT e, NULL, NULL, NULL, 'SHELL', NULL, false FROM x WHERE e % 10 = 3
UNION ALL SELECT e, NULL, NULL, CAST(e AS VARCHAR), 'SHELL', 'load-orders', true FROM x WHERE e % 10 = 4""")
def normalised_alerts(s, d):
    found = alerts.messages(view(s, d, "message").filter(alerts.is_alert(F.col("raw")) & F.try_parse_json("raw").isNotNull()))
    return alerts.normalised(found).select(
        "event_id",
        "project_code",
        "workflow_code",
        "task_instance_id",
        "task_type",
        "workflow_name",
        "is_sub_workflow"
    )


_VERBS = ("Delete", "remove", "recover", "edit", "MODIFY", "list", "drop", "online", "recover-failed", "update", "edit recover", "edit delete", "")


@query(f"""SELECT event_id, CASE WHEN v IN ('Delete', 'remove', 'edit delete') THEN 'CRITICAL' WHEN v = 'recover' THEN 'HIGH' WHEN v IN ('edit', 'MODIFY', 'edit recover') THEN 'MEDIUM' ELSE 'LOW' END AS risk,
v IN ('Delete', 'remove', 'edit delete') AS blocked, CASE v WHEN 'Delete' THEN 'delete' WHEN 'remove' THEN 'remove' WHEN 'edit delete' THEN 'delete' WHEN 'recover' THEN 'recover' WHEN 'edit' THEN 'edit' WHEN 'edit recover' THEN 'edit' WHEN 'MODIFY' THEN 'modify' END AS verb
FROM (SELECT event_id, {_sql_list(_VERBS)}[event_id % {len(_VERBS)} + 1] AS v FROM events)""")
def command_classes(s, d):
    args = F.split(F.concat(F.lit("workflow "), _listed(F.col("event_id"), _VERBS), F.lit(" x")), " ")
    return view(s, d, "events").select("event_id", alerts.command_class(args).alias("c")).select("event_id", "c.*")


_METHODS = ("get", "post", "PUT", "delete", "Patch", "HEAD")
_OPERATIONS = ("ls", "cp", "MV", "rm", "put", "sync", "stat", "mkdir", "restore")


@query(f"""SELECT event_id, lower({_sql_list(_METHODS)}[event_id % 6 + 1]) IN ('post', 'put', 'delete', 'patch') AS http_blocked,
lower({_sql_list(_OPERATIONS)}[event_id % 9 + 1]) IN ('cp', 'mv', 'rm', 'put', 'sync') AS storage_blocked FROM events""")
def write_verbs(s, d):
    e = F.col("event_id")
    return view(s, d, "events").select(
        "event_id",
        alerts.http_blocked(_listed(e, _METHODS)).alias("http_blocked"),
        alerts.storage_blocked(F.array(_listed(e, _OPERATIONS), F.lit("rm"))).alias("storage_blocked")
    )


_SAID = ("修复正确", "很有效", "✅", "正确", "修复错误", "无效", "❌ no", "错误", "I know it works now", "not valid", "正确? 错误!", "")


@query(
    f"""SELECT event_id, CASE WHEN n IN (0, 1, 2, 3, 10) THEN 'valid' WHEN n IN (4, 5, 6, 7) THEN 'invalid' ELSE 'unknown' END AS feedback FROM (SELECT event_id, event_id % {len(_SAID)} AS n FROM events)"""
)
def feedback_kinds(s, d):
    return view(s, d, "events").select("event_id", alerts.feedback(_listed(F.col("event_id"), _SAID)).alias("feedback"))


_KINDS = tuple(dict.fromkeys((*text.ERROR_CLASSES, *alerts.FIXES, "unheard_of")))


@query(f"""SELECT event_id, kind, CASE WHEN kind IN ('oom_executor', 'oom_driver', 'oom_driver_direct', 'container_killed', 'executor_lost') THEN 'RESOURCE' WHEN kind IN ('class_not_found', 'no_class_def') THEN 'CONFIG'
WHEN kind IN ('shuffle_failed', 'connection_refused') THEN 'NETWORK' WHEN kind IN ('hdfs_not_found', 'schema_mismatch') THEN 'DATA' ELSE 'EXECUTION' END AS error_class FROM (SELECT event_id, {_sql_list(_KINDS)}[event_id % {len(_KINDS)} + 1] AS kind FROM events)""")
def error_classes(s, d):
    kind = _listed(F.col("event_id"), _KINDS)
    return view(s, d, "events").select("event_id", kind.alias("kind"), text.error_class(kind).alias("error_class"))


# Present memory 1 to 5 GB (or none); history none, 9 GB with another network timeout, or 1 GB; limits 8 GB and 6 GB.
_FIX_SQL = f"""WITH x AS (SELECT event_id, {_sql_list(_KINDS)}[event_id % {len(_KINDS)} + 1] AS kind, event_id % 6 AS m, event_id % 5 % 3 AS h FROM events),
k AS (SELECT *, kind IN ('oom_executor', 'container_killed_memory', 'executor_memory_insufficient', 'gc_overhead') AS ex, kind IN ('oom_driver', 'driver_memory_insufficient') AS dr FROM x),
b AS (SELECT *, CASE WHEN m = 0 THEN CASE WHEN ex THEN 1024 ELSE 512 END ELSE m * 1024 END AS now, CASE WHEN ex THEN 8192 ELSE 6144 END AS most, CASE h WHEN 1 THEN 7168 WHEN 2 THEN 1024 ELSE 0 END AS past FROM k),
f AS (SELECT *, h > 0 AND past >= 2 * now AND past <= most AS prefer FROM b), z AS (SELECT *, CASE WHEN prefer THEN past ELSE least(2 * now, most) END AS mb FROM f),
t AS (SELECT *, CASE WHEN mb >= 1024 AND mb % 1024 = 0 THEN (mb // 1024) || 'g' ELSE mb || 'm' END AS size, CASE WHEN ex THEN greatest(mb // 4, 256) ELSE least(mb, 2048) END AS mb2 FROM z),
u AS (SELECT *, CASE WHEN mb2 >= 1024 AND mb2 % 1024 = 0 THEN (mb2 // 1024) || 'g' ELSE mb2 || 'm' END AS size2, CASE WHEN h = 1 THEN '900s' ELSE '300s' END AS net FROM t)
SELECT event_id, CASE WHEN c IS NULL THEN 'no_fix_needed' ELSE 'success' END AS status, CASE WHEN c IS NULL THEN NULL WHEN ex OR dr OR kind IN ('oom_driver_direct', 'oom_offheap') THEN 'memory_increase' ELSE 'config_change' END AS fix_type,
CASE WHEN c IS NULL THEN NULL WHEN ex OR dr THEN CASE WHEN prefer THEN 'historical' WHEN mb < 2 * now THEN 'limited' ELSE 'default' END WHEN h > 0 THEN 'historical' ELSE 'default' END AS source, coalesce(c, '') AS changes FROM (SELECT *, CASE
WHEN ex THEN 'spark.executor.memory=' || size || ',spark.executor.memoryOverhead=' || size2
WHEN kind = 'oom_driver' THEN 'spark.driver.maxResultSize=' || size2 || ',spark.driver.memory=' || size
WHEN kind = 'driver_memory_insufficient' THEN 'spark.driver.memory=' || size || ',spark.driver.memoryOverhead=?'
WHEN kind = 'broadcast_timeout' THEN 'spark.sql.autoBroadcastJoinThreshold=-1' WHEN kind = 'oom_driver_direct' THEN 'spark.driver.maxResultSize=2g' WHEN kind = 'oom_offheap' THEN 'spark.memory.offHeap.enabled=true,spark.memory.offHeap.size=2g'
WHEN kind = 'oom_storage' THEN 'spark.memory.storageFraction=0.3' WHEN kind = 'shuffle_timeout' THEN 'spark.shuffle.io.timeout=120s' WHEN kind = 'network_timeout' THEN 'spark.network.timeout=' || net WHEN kind = 'rpc_timeout' THEN 'spark.rpc.timeout=300s'
WHEN kind = 'executor_lost_heartbeat' THEN 'spark.executor.heartbeatInterval=60s,spark.network.timeout=' || net END AS c FROM u)"""


@query(_FIX_SQL)
def error_fixes(s, d):
    e = F.col("event_id")
    size = F.when(e % 6 > 0, F.concat((e % 6).cast("string"), F.lit("g")))
    config = F.create_map(F.lit("spark.executor.memory"), size, F.lit("spark.driver.memory"), size)
    past = lambda mb, *more: F.create_map(*map(F.lit, ("spark.executor.memory", mb, "spark.driver.memory", mb, *more)))
    history = F.when(e % 5 % 3 == 1, past("7g", "spark.network.timeout", "900s")).when(e % 5 % 3 == 2, past("1g"))
    errors = view(s, d, "events").select("event_id", _listed(e, _KINDS).alias("error_type"), config.alias("config"), history.alias("history"))
    shown = F.transform(F.array_sort(F.map_entries("changes")), lambda x: F.concat(x.key, F.lit("="), F.coalesce(x.value, F.lit("?"))))
    return alerts.fixes(errors, 8192, 6144).select("event_id", "status", "fix_type", "source", F.array_join(shown, ",").alias("changes"))


@query("""SELECT a.event_id AS alert_id, CASE WHEN a.event_id % 3 = 0 THEN 'c1' WHEN a.event_id % 3 = 1 THEN 'c0' END AS config FROM events a""")
def historical_fixes(s, d):
    errors = view(s, d, "events").select(
        F.col("event_id").alias("alert_id"),
        _listed(F.col("event_id"), ("oom", "other", "oom")).alias("error_type"),
        _listed(F.col("event_id"), ("w0", "w0", "w9")).alias("workflow")
    )
    configs = view(s, d, "region").select(
        F.lit("w0").alias("workflow"),
        F.col("r_regionkey").cast("int").alias("ord"),
        F.when(F.col("r_regionkey") == 1, F.array(F.lit("oom"))).otherwise(F.array(F.lit("x"))).alias("fixed_errors"),
        F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("config")
    )
    return alerts.historical_fixes(errors, configs)
