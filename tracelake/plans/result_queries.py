"""Queries of analyses put together: causes elsewhere, evidence, paths, services, actions, and what is stored of them."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import alerts, diagnosis, graph, lineage, logs, match, review, runs
from ..sources import files
from .bindings import view
from .registry import query


def _e(s, d, *columns):
    return view(s, d, "events").select(F.col("event_id").cast("string").alias("alert_id"), *columns)


def _pick(values):
    return F.get(F.array(*map(F.lit, values)), (F.col("event_id") % len(values)).cast("int"))


# The order of an event's number, and its lines as tasks of a child instance: those that were returned have failed.
@query(
    """SELECT CAST(event_id AS VARCHAR) AS alert_id, 'c' || l_orderkey AS child_instance_id, CAST(l_linenumber AS VARCHAR) AS task, 'FAILURE' AS state FROM events JOIN lineitem ON l_orderkey = event_id WHERE l_returnflag = 'R'"""
)
def sub_workflow_failures(s, d):
    children = view(s, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("task_instance_id"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("child_instance_id")
    )
    tasks = view(s, d, "lineitem").select(
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("child_instance_id"),
        F.col("l_linenumber").cast("string").alias("task"),
        F.when(F.col("l_returnflag") == "R", "FAILURE").otherwise("SUCCESS").alias("state")
    )
    return alerts.sub_workflow_failures(_e(s, d, F.col("event_id").cast("string").alias("task_instance_id")), children, tasks)


@query("""WITH i AS (SELECT project, workflow, id, start_time FROM instance QUALIFY row_number() OVER (PARTITION BY project, workflow ORDER BY start_time DESC, id DESC) = 1)
SELECT i.project, i.workflow, i.id, CASE WHEN CAST(i.id AS BIGINT) % 3 <> 0 THEN 'log of ' || i.id END AS text FROM i""")
def latest_logs(s, d):
    found = view(s, d, "instance").filter("CAST(id AS LONG) % 3 != 0").select("id", F.concat(F.lit("log of "), F.col("id")).alias("text"))
    return alerts.latest_logs(view(s, d, "instance"), found).select("project", "workflow", "id", "text")


_PATHS = ("hdfs_not_found", "input_path_error", "oom_executor")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS alert_id, CASE WHEN event_id % 3 < 2 AND event_id % 4 = 0 THEN 'AUTO_FIXABLE' ELSE 'UNKNOWN' END AS category, CASE WHEN event_id % 3 < 2 THEN 'p0:' || CASE WHEN event_id % 4 = 0 THEN 'exists:a,b,c' ELSE 'missing:' END || ';p1:empty:' END AS paths FROM events"""
)
def path_findings(s, d):
    rows = _e(s, d, _pick(_PATHS).alias("error_type"), F.lit("UNKNOWN").alias("category"))
    n = F.col("event_id")
    checked = _e(s, d, n, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord"))
    status = F.when(F.col("ord") > 0, "empty").when(n % 4 == 0, "exists").otherwise("missing")
    names = F.when((F.col("ord") == 0) & (n % 4 == 0), F.array(*map(F.lit, "abcd")))
    checked = checked.select(
        "alert_id",
        "ord",
        F.concat(F.lit("p"), F.col("ord").cast("string")).alias("path"),
        status.alias("status"),
        names.alias("files")
    )
    shown = F.transform("paths", lambda p: F.concat_ws(":", p.path, p.status, F.array_join(p.files, ",")))
    return alerts.path_findings(rows, checked).select("alert_id", "category", F.array_join(shown, ";").alias("paths"))


_EVIDENCE = ("shuffle_failed", "executor_lost", "stage_failed", "key_error")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS alert_id, concat_ws(',', 'own', CASE WHEN user_id % 2 = 0 THEN 'yarn' END, CASE event_id % 4 WHEN 0 THEN 's1' WHEN 1 THEN 'e1' WHEN 2 THEN 't1' END) AS blocks FROM events"""
)
def evidence(s, d):
    app = F.col("user_id").cast("string").alias("app")
    results = _e(s, d, app, _pick(_EVIDENCE).alias("error_type"), F.array(F.lit("own")).alias("blocks"))
    apps = view(s, d, "events").select(app).distinct()
    parts = [
        apps.select("app", F.explode(F.array(F.lit(2), F.lit(1))).alias("ord")).withColumn("text", F.concat(F.lit(x), F.col("ord").cast("string"))) for x in ("s", "e", "t")
    ]
    told = apps.filter("CAST(app AS LONG) % 2 = 0").withColumn("text", F.lit("yarn"))
    return alerts.with_evidence(results, told, *parts).select("alert_id", F.array_join("blocks", ",").alias("blocks"))


@query(
    """SELECT CAST(event_id AS VARCHAR) AS alert_id, CASE WHEN event_id % 2 = 0 THEN 'oom' END AS error_type, CASE WHEN event_id % 3 = 0 THEN 'k' END AS knowledge_id, CASE WHEN event_id % 5 = 0 THEN user_id END AS n_downstream, CASE WHEN event_id % 7 = 0 THEN 'HIGH' END AS risk FROM events"""
)
def enriched_alerts(s, d):
    e = view(s, d, "events").withColumn("alert_id", F.col("event_id").cast("string"))
    part = lambda n, c: e.filter(F.col("event_id") % n == 0).select("alert_id", c)
    return alerts.enriched(
        e.select("alert_id"),
        part(2, F.lit("oom").alias("error_type")),
        part(3, F.lit("k").alias("knowledge_id")),
        part(5, F.col("user_id").alias("n_downstream")),
        part(7, F.lit("HIGH").alias("risk"))
    )


@query(
    """SELECT '10.0.' || s_nationkey || '.' || s_suppkey % 250 AS ip, CAST(8000 + s_suppkey AS INTEGER) AS port, CASE WHEN s_suppkey % 4 <> 0 THEN 'h' || s_suppkey END AS hostname, CASE WHEN s_suppkey % 4 <> 0 THEN 'name node' END AS service FROM supplier"""
)
def known_services(s, d):
    sup, key = view(s, d, "supplier"), F.col("s_suppkey")
    ip = F.concat_ws(".", F.lit("10.0"), F.col("s_nationkey").cast("string"), (key % 250).cast("string")).alias("ip")
    told = F.concat(F.lit("name node ("), (key + 8000).cast("string"), F.lit("), other (1)")).alias("services")
    hosts = sup.filter(key % 4 != 0).select(ip, F.concat(F.lit("h"), key.cast("string")).alias("hostname"), told)
    hosts = hosts.unionByName(hosts.limit(1).withColumn("ip", F.lit("10.0.999.1")))
    return match.lookup_services(sup.select(ip, (key + 8000).cast("int").alias("port")), hosts)


@query(
    """SELECT CAST(event_id AS VARCHAR) AS code, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN user_id || ',' || user_id + 1 ELSE '' END AS depends_on, event_id % 4 = 3 AS is_empty FROM events"""
)
def declared_dependents(s, d):
    u, v = F.col("user_id").cast("string"), (F.col("user_id") + 1).cast("string")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    shapes = (
        said('{"processDefinitionCode": "', u, '"}'),
        said('{"dependence": {"dependTaskList": [{"processDefinitionCode": "', u, '"}]}}'),
        said(
            '{"dependence": {"dependTaskList": [{"dependItemList": [{"definitionCode": "',
            u,
            '"}, {"definitionCode": "',
            v,
            '"}, {"definitionCode": "',
            u,
            '"}]}]}}'
        ),
        F.lit("{}")
    )
    tasks = view(s, d, "events").select(
        F.lit("p").alias("project"),
        F.col("event_id").cast("string").alias("code"),
        F.lit("w").alias("workflow"),
        F.lit("DEPENDENT").alias("task_type"),
        F.get(F.array(*shapes), (F.col("event_id") % 4).cast("int")).alias("params")
    )
    found = lineage.dependents(tasks).withColumn(
        "depends_on",
        F.transform(F.array_sort(F.transform("depends_on", lambda x: x.cast("long"))), lambda x: x.cast("string"))
    )
    return found.select("code", F.array_join("depends_on", ",").alias("depends_on"), "is_empty")


# Tasks of a workflow in a chain by number; each third workflow is called, and two workflows follow its parent.
@query("""WITH t AS (SELECT project, workflow, code, count(*) OVER (PARTITION BY project, workflow ORDER BY CAST(code AS BIGINT) DESC) - 1 AS n FROM task),
r AS (SELECT project, workflow, code AS task, 'sub' AS scope, n FROM t WHERE n > 0 UNION ALL SELECT project, workflow, code, 'parent', 2 FROM t WHERE CAST(workflow AS BIGINT) % 3 = 0)
SELECT * FROM r UNION ALL SELECT project, workflow, task, 'total', CAST(sum(n) AS BIGINT) FROM r GROUP BY ALL""")
def sub_workflow_impacts(s, d):
    tasks = view(s, d, "task")
    chain = F.expr("lead(code) OVER (PARTITION BY project, workflow ORDER BY CAST(code AS LONG))")
    edges = tasks.select("project", F.col("code").alias("source"), chain.alias("target"))
    calls = view(s, d, "workflow").filter("CAST(code AS LONG) % 3 = 0").select(
        "project",
        F.concat(F.lit("parent"), F.col("code")).alias("source"),
        F.col("code").alias("target")
    )
    index = calls.select("project", "source", F.lit(2).cast("long").alias("n"))
    return graph.sub_workflow_impact(edges, tasks, calls, index)


_RESULT = ("module_not_found", "key_error", "disk_full", "primary_key_conflict", "nothing")
_TYPE = ("PYTHON", "PYTHON", "SHELL", "DATAX", "SPARK")


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['fix'] ELSE [] END AS f, CASE event_id % 5 WHEN 0 THEN ['检查依赖包是否安装：pip install <module>', '检查 PYTHONPATH 配置'] WHEN 1 THEN ['检查字典 key 是否存在，使用 .get() 方法避免异常'] WHEN 2 THEN ['清理磁盘空间或更换输出路径'] WHEN 3 THEN ['考虑数据去重或使用 REPLACE INTO 模式'] ELSE [] END AS t FROM events),
y AS (SELECT event_id, list_concat(f, t)[1:3] AS l FROM x) SELECT CAST(event_id AS VARCHAR) AS alert_id, i - 1 AS ord, l[i] AS action FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM y)""")
def first_actions(s, d):
    results = _e(s, d, _pick(_TYPE).alias("task_type"), _pick(_RESULT).alias("error_type"))
    fixes = _e(s, d, "event_id").filter("event_id % 2 = 0").select("alert_id", F.lit("fix").alias("fix"))
    return diagnosis.first_actions(results, fixes)


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'timeout=x1.5' WHEN 1 THEN 'retry_interval=60s' ELSE '' END AS fix, CASE WHEN event_id % 2 = 0 THEN 'LOW' ELSE 'HIGH' END AS risk, event_id % 5 = 0 OR c IN ('RESOURCE_SUGGESTED', 'UNKNOWN') OR (c = 'KNOWN_NEEDS_LLM' AND event_id % 2 = 0) AS needs_deep
FROM (SELECT event_id, ['AUTO_FIXABLE', 'KNOWN_NEEDS_LLM', 'RESOURCE_SUGGESTED', 'UNKNOWN', 'KNOWN_NEEDS_LLM', 'AUTO_FIXABLE', 'KNOWN_NEEDS_LLM'][event_id % 7 + 1] AS c FROM events)""")
def gates(s, d):
    fix = runs.quick_fix(_pick(("timeout_config_too_short", "retry_config_too_aggressive", "other")))
    category = _pick(("AUTO_FIXABLE", "KNOWN_NEEDS_LLM", "RESOURCE_SUGGESTED", "UNKNOWN", "KNOWN_NEEDS_LLM", "AUTO_FIXABLE", "KNOWN_NEEDS_LLM"))
    shown = F.coalesce(F.array_join(F.transform(F.map_entries(fix), lambda x: F.concat_ws("=", x.key, x.value)), ","), F.lit(""))
    deep = alerts.needs_deep_analysis(F.col("event_id") % 5, category, _pick(("executor_crash", "key_error")))
    return view(s, d, "events").select(
        "event_id",
        shown.alias("fix"),
        alerts.skill_risk(_pick(("AUTO_FIXABLE", "UNKNOWN"))).alias("risk"),
        deep.alias("needs_deep")
    )


@query("""SELECT count(*) AS handled, count(*) FILTER (event_id % 3 = 0) AS executed FROM events""")
def batch_counts(s, d):
    return alerts.batch_counts(view(s, d, "events").select((F.col("event_id") % 3 == 0).alias("executed")))


# Runs as errors of four kinds; without a shuffle the memory is doubled, or follows spills.
@query("""WITH x AS (SELECT run, ['oom_executor', 'oom_driver', 'shuffle_failed', 'key_error'][run % 4 + 1] AS kind, executor_memory_mb AS mb, executor_instances AS n, CASE WHEN run % 3 = 0 THEN 0 ELSE shuffle_read_mb END AS sh, CASE WHEN run % 5 = 0 THEN 700 ELSE 0 END AS spill FROM run_history),
y AS (SELECT *, CASE WHEN sh = 0 THEN 'unknown' WHEN mb * n / sh < 1 THEN 'risky' WHEN mb * n / sh < 1.5 THEN 'need_increase' WHEN mb * n / sh <= 2 THEN 'optimal' WHEN mb * n / sh <= 3 THEN 'slightly_over' ELSE 'over_configured' END AS status FROM x WHERE kind <> 'key_error')
SELECT run AS alert_id, status, CASE WHEN status = 'risky' THEN 'HIGH' WHEN status IN ('need_increase', 'optimal') THEN 'MEDIUM' WHEN status IN ('slightly_over', 'over_configured') AND kind = 'oom_executor' THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
CASE WHEN sh > 0 THEN 'balanced_config' WHEN spill > 0 THEN 'oom_spill' ELSE 'fallback_double' END AS method, CASE WHEN sh > 0 THEN NULL WHEN spill > 0 THEN mb + spill ELSE mb * 2 END AS memory FROM y WHERE status <> 'optimal' OR kind = 'oom_executor'""")
def resource_suggestions(s, d):
    none = F.lit(None).cast("long")
    kind = F.get(F.array(*map(F.lit, ("oom_executor", "oom_driver", "shuffle_failed", "key_error"))), (F.col("run") % 4).cast("int"))
    r = view(s, d, "run_history").select(
        F.col("run").alias("alert_id"),
        kind.alias("error_type"),
        F.col("executor_memory_mb").alias("executor_mb"),
        F.col("executor_instances").alias("instances"),
        none.alias("predicted_mb"),
        F.when(F.col("run") % 5 == 0, 700).otherwise(0).alias("spilled_mb"),
        none.alias("peak_mb"),
        F.when(F.col("run") % 3 == 0, 0).otherwise(F.col("shuffle_read_mb")).alias("shuffle_mb"),
        F.lit(4).alias("slots")
    )
    return runs.resource_suggestions(r).select(
        "alert_id",
        "status",
        "confidence",
        "method",
        F.when(F.col("method") != "balanced_config", F.col("suggested_mb")).alias("memory")
    )


@query(
    """SELECT doc_id, md5(substr(text, 1, 500)) AS log_md5, coalesce(c, 0.5) AS confidence FROM (SELECT *, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 10 AS DOUBLE) / 10 END AS c FROM documents) WHERE coalesce(c, 0.5) >= 0.5"""
)
def new_candidates(s, d):
    rows = view(s, d, "documents").select(
        "doc_id",
        F.col("source").alias("skill_name"),
        F.col("text").alias("original_log"),
        F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 10).cast("double") / 10).alias("confidence")
    )
    return review.new_candidates(rows, keep=("doc_id",)).select("doc_id", F.md5("original_log").alias("log_md5"), "confidence")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS log_id, CAST(event_id AS VARCHAR) AS pos, CASE WHEN event_id % 2 = 0 THEN 'ERROR a' || event_id || chr(10) || 'Caused by: x' || chr(10) || 'Caused by: y' || user_id ELSE 'ERROR b' || chr(10) || 'at c' END AS summary FROM events"""
)
def block_summaries(s, d):
    number = F.col("event_id").cast("string")
    frames = F.array_join(F.array_repeat(F.lit("\tat a.b(C.java:1)"), 12), "\n")
    long = F.concat(
        F.lit("ERROR a"),
        number,
        F.lit("\n"),
        frames,
        F.lit("\nCaused by: x\n"),
        frames,
        F.lit("\nCaused by: y"),
        F.col("user_id").cast("string")
    )
    block = F.when(F.col("event_id") % 2 == 0, long).otherwise("ERROR b\nat c")
    return view(s, d, "events").select(F.col("user_id").cast("string").alias("log_id"), number.alias("pos"), logs.summary(block).alias("summary"))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS code, 'w' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'CRON' ELSE 'MANUAL' END AS schedule_type, CASE WHEN o_orderkey % 3 = 0 THEN 'UTC' ELSE 'Asia/Shanghai' END AS timezone, 1 AS n_tasks, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS n_edges FROM orders"""
)
def parsed_definitions(s, d):
    k = F.col("o_orderkey").cast("string")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    when = F.when(F.col("o_orderkey") % 3 == 0, ', "schedule": {"crontab": "0 0 * * *", "timezoneId": "UTC"}').otherwise("")
    own = said(
        '{"data": {"workflow": {"code": ',
        k,
        ', "name": "w',
        k,
        '"',
        when,
        '}, "tasks": [{"code": "t',
        k,
        '", "name": "t"}, {"name": "lost"}], "relations": [{"preTaskCode": 0, "postTaskCode": 1}]}}'
    )
    other = said(
        '{"workflowDefinition": {"code": ',
        k,
        ', "name": "w',
        k,
        '"',
        when,
        '}, "taskDefinitionList": [{"code": "t',
        k,
        '"}], "workflowTaskRelationList": [{"preTaskCode": "t',
        k,
        '", "postTaskCode": 9}]}'
    )
    rows = view(s, d, "orders").select(F.lit("p").alias("project_code"), F.when(F.col("o_orderkey") % 2 == 0, own).otherwise(other).alias("response"))
    got = files.parse_definitions(rows)
    tasks = got["tasks"].groupBy(F.col("workflow").alias("code")).agg(F.count("*").alias("n_tasks"))
    edges = got["edges"].withColumn(
        "code",
        F.regexp_replace(F.when(F.col("edge_type") == "workflow_contains_task", F.col("source")).otherwise(F.col("source")), "^t", "")
    ).groupBy("code").agg(F.count("*").alias("n_edges"))
    return got["workflows"].select("code", "name", "schedule_type", "timezone").join(tasks, "code").join(edges, "code")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS id, least(length(coalesce(repeat('x', CAST(event_id % 900 AS INTEGER)), '')), 500) AS n_chars, CAST(ts AS DATE) AS dt FROM events"""
)
def audit_rows(s, d):
    rows = view(s, d, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.repeat(F.lit("x"), (F.col("event_id") % 900).cast("int")).alias("operation_detail"),
        F.col("ts").alias("timestamp")
    )
    return files.audit_rows(rows).select("id", F.length("operation_detail").cast("long").alias("n_chars"), "dt")


@query(
    """SELECT project, count(*) AS n, count(*) FILTER (sev = 'HIGH') AS n_high, count(*) FILTER (sev = 'LOW') AS n_low, string_agg(code, ',' ORDER BY sev, code) AS subjects FROM (SELECT project, code, CASE WHEN CAST(code AS BIGINT) % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS sev FROM workflow) GROUP BY project"""
)
def issue_reports(s, d):
    severity = F.when(F.col("code").cast("long") % 3 == 0, "HIGH").otherwise("LOW")
    issues = view(s, d, "workflow").select(
        "project",
        F.lit("c").alias("category"),
        severity.alias("severity"),
        F.col("code").alias("subject"),
        F.lit("").alias("detail")
    )
    return files.issue_report(issues).select(
        "project",
        "n",
        "n_high",
        "n_low",
        F.array_join(F.transform("issues", lambda x: x.subject), ",").alias("subjects")
    )


# A catalogue for each nation: two categories, of which one is unknown, with a rule a row.
@query("""SELECT CAST(n_nationkey AS VARCHAR) AS task_type, 'AUTO_FIXABLE' AS category, 'Memory' AS sub_category, 'oom' || n_nationkey AS error_type, 'a|b' || n_nationkey AS pattern, 'more' AS hint FROM nation
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'KNOWN_NEEDS_LLM', 'Other', 'late', 'slow.*', 'wait' FROM nation""")
def parsed_catalogues(s, d):
    k = F.col("n_nationkey").cast("string")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    rows = (
        "# Rules",
        "## AUTO_FIXABLE",
        "### Memory",
        "| type | pattern | hint |",
        "|-|-|-|",
        said("| oom", k, " | `a|b", k, "` | more |"),
        "## Notes",
        "| x | `y` | z |",
        "## KNOWN_NEEDS_LLM",
        "### Other",
        "| late | `slow.*` | wait |"
    )
    listed = F.array(*(r if not isinstance(r, str) else F.lit(r) for r in rows))
    lines = view(s, d, "nation").select(k.alias("task_type"), F.posexplode(listed).alias("line_no", "line"))
    return files.parse_catalogue(lines).select("task_type", "category", "sub_category", "error_type", "pattern", "hint")


@query(
    """SELECT event_id, concat_ws(chr(10), CASE WHEN event_id % 2 = 0 THEN 'd' || event_id END, CASE WHEN event_id % 3 = 0 THEN 's' || user_id END, 'y') AS log FROM events"""
)
def combined_logs(s, d):
    part = lambda n, x, c: F.when(F.col("event_id") % n == 0, F.concat(F.lit(x), F.col(c).cast("string"))).otherwise("")
    return view(s, d, "events").select("event_id", text.combined(part(2, "d", "event_id"), part(3, "s", "user_id"), F.lit("y")).alias("log"))
