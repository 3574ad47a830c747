"""Alerts: normalising, routing, tracing to what failed, risk, actions and reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import memory_mb, memory_text_whole

# The message keys that a field may come under, and task types with an analysis of their own.
ALIASES = {
    "project_code": ("projectCode", "project_code"),
    "workflow_code": ("processDefinitionCode", "workflowCode"),
    "instance_id": ("processInstanceId", "processId", "workflowInstanceId"),
    "instance_name": ("processName", "processInstanceName", "workflowInstanceName"),
    "task_code": ("taskCode",),
    "task_name": ("taskName",),
    "task_instance_id": ("taskInstanceId", "taskId"),
    "task_type": ("taskType",),
    "state": ("taskState", "state"),
    "log_path": ("logPath",),
    "root_id": ("rootProcessInstanceId",),
    "start_time": ("taskStartTime", "startTime"),
    "end_time": ("taskEndTime", "endTime"),
}
TASK_TYPES = ("SPARK", "SHELL", "PYTHON", "DATAX", "SQL", "DEPENDENT", "SUB_PROCESS")


def messages(raw: DataFrame, col: str = "raw") -> DataFrame:
    """One row for each alert in a message: an object, a list, or an object whose `alerts` is a list, also as text."""
    v = F.try_parse_json(col)
    inner = F.coalesce(
        F.try_variant_get(v, "$.alerts", "array<variant>"),
        F.try_variant_get(F.try_parse_json(F.try_variant_get(v, "$.alerts", "string")), "$", "array<variant>")
    )
    items = F.coalesce(inner, F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return raw.select(*raw.columns, F.explode(items).alias("alert")).filter("alert IS NOT NULL")


def normalised(alerts: DataFrame, col: str = "alert") -> DataFrame:
    """Alerts (variants) as columns: aliases resolved, types in upper case, ids from the log's name, workflow names."""
    field = lambda names: F.coalesce(*(F.try_variant_get(col, f"$.{n}", "string") for n in names))
    out = alerts.select(
        *(c for c in alerts.columns if c != col),
        *(field(names).alias(k) for k, names in ALIASES.items()),
        F.to_json(col).alias("payload")
    )
    kind = F.upper(F.trim("task_type"))
    out = out.withColumn("task_type", F.when(kind.isin(*TASK_TYPES), kind).otherwise("SHELL"))
    out = out.withColumn("task_instance_id", F.coalesce("task_instance_id", F.nullif(F.regexp_extract("log_path", r"(\d+)\.log$", 1), F.lit(""))))
    parts = F.split("instance_name", "-")
    out = out.withColumn(
        "workflow_name",
        F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.size(parts) - 2), "-")).otherwise(F.col("instance_name"))
    )
    return out.withColumn("is_sub_workflow", F.coalesce(F.col("root_id") != F.col("instance_id"), F.lit(False)))


# Keys that tell an alert, in an object, in the first object of a list, in a request, and in text that is no JSON.
MESSAGE_KEYS = ("alerts", "projectCode", "processDefinitionCode", "taskInstanceId", "taskType")
LIST_KEYS = ("projectCode", "processDefinitionCode", "taskInstanceId")
REQUEST_KEYS = ("processInstanceId", "taskCode", "taskType", "processDefinitionCode")
TEXT_PATTERNS = (
    r'"projectCode"\s*:',
    r'"processDefinitionCode"\s*:',
    r'"taskInstanceId"\s*:',
    r'"taskType"\s*:',
    r'"alerts"\s*:',
)


def _has_key(json: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(json), F.array(*map(F.lit, keys))), F.lit(False))


def is_alert(text: Column) -> Column:
    """Whether a message is an alert: an object or the first object of a list with a known key, whatever its value, or text
    that is no JSON with two of the keys."""
    hits = sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in TEXT_PATTERNS), F.lit(0))
    in_json = _has_key(text, MESSAGE_KEYS) | _has_key(F.get_json_object(text, "$[0]"), LIST_KEYS)
    return in_json | (F.try_parse_json(text).isNull() & (hits >= 2))


def is_request(text: Column) -> Column:
    """Whether a request (JSON) is about an alert rather than a question."""
    return _has_key(text, REQUEST_KEYS)


# Verbs of recorded commands by what they may do.
BLOCKED = ("delete", "remove")
RISKS_OF_VERBS = {"recover": "HIGH", "edit": "MEDIUM", "modify": "MEDIUM"}
HTTP_BLOCKED = ("POST", "PUT", "DELETE", "PATCH")
STORAGE_BLOCKED = ("cp", "mv", "rm", "put", "sync")


def command_class(args: Column) -> Column:
    """Struct (risk, blocked, verb) of a recorded command's arguments: the first verb that blocks it, else the first that
    carries a risk."""
    low = F.transform(args, lambda x: F.lower(x))
    first = lambda verbs: F.get(F.filter(low, lambda x: F.coalesce(x.isin(*verbs), F.lit(False))), F.lit(0))
    blocked, risky = first(BLOCKED), first(tuple(RISKS_OF_VERBS))
    risk = F.element_at(F.create_map(*(F.lit(x) for kv in RISKS_OF_VERBS.items() for x in kv)), risky)
    return F.struct(
        F.when(blocked.isNotNull(), "CRITICAL").otherwise(F.coalesce(risk, F.lit("LOW"))).alias("risk"),
        blocked.isNotNull().alias("blocked"),
        F.coalesce(blocked, risky).alias("verb")
    )


def http_blocked(method: Column) -> Column:
    return F.coalesce(F.upper(method).isin(*HTTP_BLOCKED), F.lit(False))


def storage_blocked(args: Column) -> Column:
    """By a command's first argument, its operation."""
    return F.coalesce(F.lower(F.get(args, F.lit(0))).isin(*STORAGE_BLOCKED), F.lit(False))


# What feedback says.
VALID = ("修复正确", "有效", "✅", "正确")
INVALID = ("修复错误", "无效", "❌", "错误")


def feedback(text: Column, valid: tuple[str, ...] = VALID, invalid: tuple[str, ...] = INVALID) -> Column:
    """valid, else invalid, else unknown, by the words in a text."""
    has = lambda words: F.coalesce(F.lower(text).rlike("|".join(words).lower()), F.lit(False))
    return F.when(has(valid), "valid").when(has(invalid), "invalid").otherwise("unknown")


def upstream_failures(alerts: DataFrame, instances: DataFrame, hours: int = 6, tasks: DataFrame | None = None) -> DataFrame:
    """The first upstream instance that failed within +-hours of each alert; with tasks(instance_id, task, state), also the
    sorted tasks of it that failed.

    alerts(alert_id, project, upstream, ts), instances(id, project, workflow, state, start_time). Both sides are cut into
    buckets as wide as the range, so that the join is on equality; each alert looks into the three it can reach.
    """
    width = hours * 3600
    secs = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    reach = alerts.withColumn("_b", F.explode(F.sequence(F.floor(secs("ts") / width) - 1, F.floor(secs("ts") / width) + 1)))
    failed = instances.filter("state = 'FAILURE'").select(
        "project",
        F.col("workflow").alias("upstream"),
        F.col("id").alias("instance_id"),
        "start_time",
        F.floor(secs("start_time") / width).alias("_b")
    )
    pairs = reach.join(failed, ["project", "upstream", "_b"]).filter(F.abs(secs("start_time") - secs("ts")) <= width)
    first = pairs.groupBy("alert_id").agg(F.min(F.struct("start_time", "instance_id")).alias("f")).select("alert_id", "f.instance_id", "f.start_time")
    if tasks is None:
        return first
    failed_tasks = tasks.filter("state = 'FAILURE'").groupBy("instance_id").agg(F.array_sort(F.collect_set("task")).alias("failed_tasks"))
    return first.join(failed_tasks, "instance_id", "left").withColumn("failed_tasks", F.coalesce("failed_tasks", F.array().cast("array<string>")))


def sub_workflow_failures(alerts: DataFrame, children: DataFrame, tasks: DataFrame) -> DataFrame:
    """Failed tasks of the child instance that an alert's task instance started."""
    return alerts.join(children, "task_instance_id").join(tasks.filter("state = 'FAILURE'"), "child_instance_id").select("alert_id", "child_instance_id", "task", "state")


def latest_instances(instances: DataFrame) -> DataFrame:
    """The newest instance of each workflow; of equal times the one with the greatest id."""
    return instances.groupBy("project", "workflow").agg(F.max(F.struct("start_time", "id")).alias("m")).select("project", "workflow", "m.id", "m.start_time")


def latest_logs(instances: DataFrame, logs: DataFrame) -> DataFrame:
    """The newest instance of each workflow with its log (id, text), null without one."""
    return latest_instances(instances).join(logs.select("id", "text"), "id", "left")


RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def action_risk(action: Column, structural: Column, multi_param: Column, retries: Column, n_downstream: Column) -> Column:
    """0 to 3, an index of RISKS."""
    return (
        F.when(action.isin("delete", "cross_project"), 3)
        .when(((action == "recover-failed") & (n_downstream > 5)) | structural, 2)
        .when(multi_param | ((action == "rerun") & (retries > 3)) | ((action == "recover-failed") & (n_downstream >= 1)), 1)
        .otherwise(0)
    )


def alert_risk(actions: DataFrame) -> DataFrame:
    """The greatest risk among an alert's actions, and whether it needs approval."""
    r = action_risk(*(F.col(c) for c in ("action_type", "structural", "multi_param", "retry_count", "n_downstream")))
    out = actions.groupBy("alert_id").agg(F.max(r).alias("r"))
    return out.select("alert_id", F.array(*map(F.lit, RISKS))[F.col("r")].alias("risk"), (F.col("r") >= 2).alias("needs_approval"))


def skill_risk(category: Column) -> Column:
    return F.when(category == "AUTO_FIXABLE", "LOW").otherwise("HIGH")


# Errors of known kinds that need a look into the event log.
DEEP_ERRORS = (
    "shuffle_failed",
    "shuffle_connection",
    "executor_lost",
    "executor_crash",
    "executor_lost_heartbeat",
    "container_killed",
    "yarn_container_exit",
    "broadcast_timeout",
    "stage_failed",
    "task_failed",
    "driver_disconnected",
    "block_manager_lost",
)


def needs_deep_analysis(n_blocks: Column, category: Column, error_type: Column) -> Column:
    """Without blocks, or of a category that always needs it, or one of DEEP_ERRORS among the known ones."""
    known = (category == "KNOWN_NEEDS_LLM") & error_type.isin(*DEEP_ERRORS)
    return F.coalesce((n_blocks == 0) | category.isin("RESOURCE_SUGGESTED", "UNKNOWN") | known, F.lit(False))


# By error, the kind of fix and the settings that it changes; None is worked out.
FIXES = {
    "oom_executor": ("memory_increase", {"spark.executor.memory": None, "spark.executor.memoryOverhead": None}),
    "oom_driver": ("memory_increase", {"spark.driver.memory": None, "spark.driver.maxResultSize": None}),
    "container_killed_memory": ("memory_increase", {"spark.executor.memory": None, "spark.executor.memoryOverhead": None}),
    "broadcast_timeout": ("config_change", {"spark.sql.autoBroadcastJoinThreshold": "-1"}),
    "oom_driver_direct": ("memory_increase", {"spark.driver.maxResultSize": "2g"}),
    "oom_offheap": ("memory_increase", {"spark.memory.offHeap.enabled": "true", "spark.memory.offHeap.size": "2g"}),
    "oom_storage": ("config_change", {"spark.memory.storageFraction": "0.3"}),
    "shuffle_timeout": ("config_change", {"spark.shuffle.io.timeout": "120s"}),
    "network_timeout": ("config_change", {"spark.network.timeout": "300s"}),
    "rpc_timeout": ("config_change", {"spark.rpc.timeout": "300s"}),
    "executor_lost_heartbeat": ("config_change", {"spark.executor.heartbeatInterval": "60s", "spark.network.timeout": "300s"}),
    "gc_overhead": ("memory_increase", {"spark.executor.memory": None, "spark.executor.memoryOverhead": None}),
    "driver_memory_insufficient": ("memory_increase", {"spark.driver.memory": None, "spark.driver.memoryOverhead": None}),
    "executor_memory_insufficient": ("memory_increase", {"spark.executor.memory": None, "spark.executor.memoryOverhead": None}),
}
EXECUTOR_MEMORY_ERRORS = ("oom_executor", "container_killed_memory", "executor_memory_insufficient", "gc_overhead")
DRIVER_MEMORY_ERRORS = ("oom_driver", "driver_memory_insufficient")


def fixes(errors: DataFrame, executor_limit_mb: int | None = None, driver_limit_mb: int | None = None) -> DataFrame:
    """errors with status, fix_type, source and changes (a map of settings).

    errors has error_type and the maps config (the present settings) and history (those of a past run that went well, see
    historical_fixes(); null without one). Memory is doubled within the cluster's limit; history is preferred where it
    gives as much within the limit, and for the settings that aren't memory. The table of fixes has 14 rows, so it is
    broadcast.
    """
    rows = [(e, kind, changes) for e, (kind, changes) in FIXES.items()]
    table = errors.sparkSession.createDataFrame(rows, "error_type string, fix_type string, _default map<string, string>")

    def memory(key: str, least: int, limit: int | None) -> tuple[Column, Column]:
        """(MB, source)"""
        now = F.coalesce(memory_mb(F.element_at("config", key)), F.lit(least))
        most = F.lit(limit if limit and limit > 0 else None).cast("long")
        past = F.coalesce(memory_mb(F.element_at("history", key)), F.lit(0))
        prefer = some_history & (past >= 2 * now) & F.coalesce(past <= most, F.lit(True))
        mb = F.when(prefer, past).otherwise(F.least(2 * now, most)).cast("long")
        return mb, F.when(prefer, "historical").when(mb < 2 * now, "limited").otherwise("default")

    out = errors.join(F.broadcast(table), "error_type", "left")
    some_history = F.coalesce(F.size("history") > 0, F.lit(False))
    executor, driver = F.col("error_type").isin(*EXECUTOR_MEMORY_ERRORS), F.col("error_type").isin(*DRIVER_MEMORY_ERRORS)
    (e_mb, e_from), (d_mb, d_from) = memory("spark.executor.memory", 1024, executor_limit_mb), memory("spark.driver.memory", 512, driver_limit_mb)
    size = memory_text_whole
    for_executor = F.create_map(
        F.lit("spark.executor.memory"),
        size(e_mb),
        F.lit("spark.executor.memoryOverhead"),
        size(F.greatest(F.floor(e_mb / 4), F.lit(256)))
    )
    second = F.map_filter("_default", lambda k, _: k != "spark.driver.memory")
    for_driver = F.map_concat(
        F.create_map(F.lit("spark.driver.memory"), size(d_mb)),
        F.transform_values(second, lambda k, v: F.when(k == "spark.driver.maxResultSize", size(F.least(d_mb, F.lit(2048)))))
    )
    others = F.transform_values("_default", lambda k, v: F.coalesce(F.element_at("history", k), v))
    none = F.from_json(F.lit("{}"), "map<string, string>")
    found = F.col("fix_type").isNotNull()
    changes = F.when(~found, none).when(executor, for_executor).when(driver, for_driver).otherwise(others)
    source = F.when(executor, e_from).when(driver, d_from).when(some_history, "historical").otherwise("default")
    return out.withColumn(
        "status",
        F.when(found, "success").otherwise("no_fix_needed")
    ).withColumn("source", F.when(found, source)).withColumn("changes", changes).drop("_default")


def actions_of(results: DataFrame, most: int = 3) -> DataFrame:
    """A fix first, then suggestions, up to most: (alert_id, ord, action). results(alert_id, fix, suggestions)."""
    listed = F.slice(F.concat(F.array_compact(F.array("fix")), F.coalesce("suggestions", F.array().cast("array<string>"))), 1, most)
    return results.select("alert_id", F.posexplode(listed).alias("ord", "action"))


def enriched(alerts: DataFrame, *analyses: DataFrame) -> DataFrame:
    """An alert with what each analysis says of it (rule, knowledge, impact, risk), all keyed by alert_id; what is missing
    stays null."""
    out = alerts
    for x in analyses:
        out = out.join(x, "alert_id", "left")
    return out


def batch_counts(handled: DataFrame) -> DataFrame:
    return handled.agg(F.count("*").alias("handled"), F.count_if("executed").alias("executed"))


#: The sections of a stored report and their columns.
SECTIONS = {
    "basic_info": ("report_time", "project_name", "project_code", "workflow_name", "task_name", "task_code", "task_type", "instance_id", "error_time", "is_sub_workflow"),
    "analysis_process": ("error_patterns", "category", "n_blocks"),
    "error_analysis": ("error_type", "error_class", "root_cause", "hint"),
    "skill_result": ("facts", "needs_deep"),
    "log_preprocess": ("driver_log_chars", "spark_log_chars", "yarn_log_chars", "log_text"),
    "resource_data": ("data_metrics", "spark_metrics"),
    "risk_assessment": ("risk", "needs_approval", "n_downstream", "impact_level", "impact_source"),
    "suggested_actions": ("actions",),
    "execution_result": ("executed_actions", "execution_success"),
    "token_consumption": ("tokens",),
    "approval_status": ("approval",),
}


def reports(rows: DataFrame, excerpt: int = 500) -> DataFrame:
    """One nested record for each alert, as it is stored: alert_id, dt, workflow_code and SECTIONS. Columns that rows doesn't
    have are null; of log_text an excerpt is kept."""

    def field(c: str) -> Column:
        value = F.col(c) if c in rows.columns else F.lit(None).cast("string")
        return (F.substring(value, 1, excerpt) if c == "log_text" else value).alias(c)

    return rows.select("alert_id", "dt", "workflow_code", *(F.struct(*map(field, columns)).alias(k) for k, columns in SECTIONS.items()))


def list_reports(stored: DataFrame, dt: str, workflow: str | None = None, n: int = 20) -> DataFrame:
    out = stored.filter(F.col("dt") == dt)
    out = out.filter(F.col("workflow_code") == workflow) if workflow else out
    return out.orderBy("alert_id").limit(n)


class Skills:
    """Analyses by task type: functions from a slice of alerts (with logs) to one of results; unknown types use the
    default. Each runs once, over all alerts of its types."""

    def __init__(self, default):
        self.default, self.by_type = default, {}

    def register(self, types: tuple[str, ...], skill) -> None:
        self.by_type |= dict.fromkeys(types, skill)

    def analyse(self, alerts: DataFrame) -> DataFrame:
        parts = []
        for skill in dict.fromkeys(self.by_type.values()):
            parts.append(skill(alerts.filter(F.col("task_type").isin(*(t for t, f in self.by_type.items() if f is skill)))))
        rest = alerts.filter(~F.coalesce(F.col("task_type").isin(*self.by_type), F.lit(False))) if self.by_type else alerts
        out = self.default(rest)
        for p in parts:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


def feedback_matches(feedbacks: DataFrame, executions: DataFrame, seconds: int = 300) -> DataFrame:
    """Each feedback(user, ts) with the user's last execution(user, ts, execution_id) up to `seconds` before.

    Rows meet in spans of `seconds`, so that a user with many is the work of many tasks; where a span has no execution
    before a feedback, the last one of the span before it counts.
    """
    kind = feedbacks.schema["feedback_id"].dataType
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = feedbacks.select("user", "ts", "feedback_id", F.lit(None).cast("string").alias("execution_id"), F.lit(1).alias("o")).unionByName(
        executions.select("user", "ts", F.lit(None).cast(kind).alias("feedback_id"), F.col("execution_id").cast("string"), F.lit(0).alias("o"))
    )
    rows = rows.withColumn("_at", micros).withColumn("_span", F.floor(F.col("_at") / (seconds * 1_000_000)))
    at = Window.partitionBy("user", "_span").orderBy("_at", "o").rowsBetween(Window.unboundedPreceding, 0)
    execution = F.struct(F.col("_at").alias("at"), "execution_id")
    last = F.last(F.when(F.col("o") == 0, execution), ignorenulls=True).over(at)
    asked = rows.withColumn("l", last).filter("o = 1").select("user", "feedback_id", "_at", "_span", "l")
    ends = rows.filter("o = 0").groupBy(F.col("user").alias("_user"), (F.col("_span") + 1).alias("_next")).agg(F.max_by(execution, "_at").alias("p"))
    out = asked.join(ends, F.col("user").eqNullSafe(F.col("_user")) & (F.col("_span") == F.col("_next")), "left").withColumn("l", F.coalesce("l", "p"))
    return out.select("user", "feedback_id", F.when(F.col("_at") - F.col("l.at") <= seconds * 1_000_000, F.col("l.execution_id")).alias("execution_id"))


def approvals_at(requests: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """The state of each request: the first decision before its expiry counts; without one it is pending, then timed out.

    requests(request_id, created_at, expires_at), decisions(request_id, ts, status).
    """
    in_time = decisions.join(requests.select("request_id", "expires_at"), "request_id").filter(F.col("ts") <= F.col("expires_at"))
    first = in_time.groupBy("request_id").agg(F.min(F.struct("ts", "status")).alias("d"))
    out = requests.join(first, "request_id", "left")
    return out.select("request_id", F.coalesce("d.status", F.when(now > F.col("expires_at"), "timeout").otherwise("pending")).alias("status"))


def historical_fixes(errors: DataFrame, configs: DataFrame) -> DataFrame:
    """Each error's first past configuration that fixed it, else the first of all.

    errors(alert_id, error_type, workflow), configs(workflow, ord, fixed_errors, config).
    """
    pairs = errors.join(configs, "workflow", "left")
    best = F.min_by("config", F.struct((~F.coalesce(F.array_contains("fixed_errors", F.col("error_type")), F.lit(False))).alias("a"), "ord"))
    return pairs.groupBy("alert_id").agg(best.alias("config"))


# Errors of paths.
PATH_ERRORS = ("hdfs_not_found", "file_not_found", "partition_not_found", "path_not_found", "input_path_error", "output_path_error")


def path_findings(alerts: DataFrame, checked: DataFrame, n_paths: int = 2, n_files: int = 3) -> DataFrame:
    """Alerts of path errors with the state of their first paths and the first files in each; if the first path exists, the
    alert can be fixed.

    alerts(alert_id, error_type, category), checked(alert_id, ord, path, status, files).
    """
    row = F.struct("ord", "path", "status", F.slice(F.coalesce("files", F.array().cast("array<string>")), 1, n_files).alias("files"))
    by = checked.filter(F.col("ord") < n_paths).groupBy("alert_id").agg(F.array_sort(F.collect_list(row)).alias("paths"))
    out = alerts.join(by, "alert_id", "left")
    hit = F.coalesce(F.col("error_type").isin(*PATH_ERRORS), F.lit(False))
    first_exists = F.coalesce(F.get("paths", F.lit(0)).status == "exists", F.lit(False))
    return out.withColumn("paths", F.when(hit, F.col("paths"))).withColumn(
        "category",
        F.when(hit & first_exists, "AUTO_FIXABLE").otherwise(F.col("category"))
    )


def with_evidence(results: DataFrame, diagnostics: DataFrame, stages: DataFrame, executors: DataFrame, tasks: DataFrame) -> DataFrame:
    """results(alert_id, app, error_type, blocks) with what the event log adds to the blocks of some error types.

    diagnostics(app, text), and by app the first failed stage, removed executor and failed task as (app, ord, text).
    """
    first = lambda df, name: df.groupBy("app").agg(F.min_by("text", "ord").alias(name))
    out = results.join(diagnostics.select("app", F.col("text").alias("_d")), "app", "left")
    for df, name in ((stages, "_s"), (executors, "_e"), (tasks, "_t")):
        out = out.join(first(df, name), "app", "left")
    kind = F.lower("error_type")
    more = F.array_compact(
        F.array(
            F.col("_d"),
            F.when(kind.contains("shuffle"), F.col("_s")),
            F.when(kind.contains("executor"), F.col("_e")),
            F.when(kind.rlike("stage|task|job"), F.col("_t"))
        )
    )
    return out.withColumn("blocks", F.array_union("blocks", more)).drop("_d", "_s", "_e", "_t")
