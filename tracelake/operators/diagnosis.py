"""Diagnosis of alerts by task type: blocks, matching rule, root cause, facts of the type, and what is to be done.

Every skill is a function from a slice of alerts (alert_id, task_type, text, and what the skill names) to COLUMNS; what it
finds besides goes into the map `facts`, so that the slices of all types make one table.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dependency_facts, diagnostics_tail, error_class, sync_facts
from . import logs, match, runs
from .alerts import Skills, needs_deep_analysis, skill_risk, with_evidence

COLUMNS = (
    "alert_id",
    "task_type",
    "category",
    "error_type",
    "hint",
    "n_blocks",
    "blocks",
    "root_cause",
    "error_class",
    "risk",
    "needs_deep",
    "facts"
)
Skill = Callable[[DataFrame], DataFrame]

# Suggestions by task type and error types.
SUGGESTIONS = {
    ("SPARK", ("class_not_found", "no_class_def")): ("检查依赖包是否已上传到资源中心",),
    ("SPARK", ("shuffle_failed", "shuffle_connection")): ("检查 Shuffle Service 状态或增加 shuffle service",),
    ("SPARK", ("hdfs_not_found", "file_not_found")): ("检查输入文件路径是否存在",),
    ("SPARK", ("schema_mismatch",)): ("检查数据 Schema 是否匹配",),
    ("SHELL", ("syntax_error", "unexpected_eof", "unexpected_token")): ("检查 Shell 脚本语法：引号闭合、括号匹配、if/for/while 结构",),
    ("SHELL", ("permission_denied", "access_denied")): ("检查文件或目录权限，确认执行用户有足够权限",),
    ("SHELL", ("no_such_file", "file_not_found", "directory_not_exist")): ("检查文件路径是否存在，确认路径拼写正确",),
    ("SHELL", ("connection_refused", "connection_timeout")): ("检查目标服务是否运行，确认网络连通性",),
    ("SHELL", ("disk_full", "no_space_left")): ("清理磁盘空间或更换输出路径",),
    ("PYTHON", ("syntax_error", "indentation_error")): ("检查代码语法：引号闭合、括号匹配、缩进一致性",),
    ("PYTHON", ("module_not_found", "import_error")): ("检查依赖包是否安装：pip install <module>", "检查 PYTHONPATH 配置"),
    ("PYTHON", ("key_error",)): ("检查字典 key 是否存在，使用 .get() 方法避免异常",),
    ("PYTHON", ("index_error",)): ("检查列表索引范围，使用 len() 确认长度",),
    ("PYTHON", ("file_not_found",)): ("检查文件路径是否正确，确认文件存在",),
    ("PYTHON", ("name_error",)): ("检查变量是否已定义，确认作用域正确",),
    ("DATAX", ("connection_refused", "connection_timeout", "source_connection")): ("检查数据库连接配置：URL、端口、用户名、密码", "确认数据库服务正常运行"),
    ("DATAX", ("permission_denied", "access_denied")): ("检查数据库用户是否有足够的读写权限",),
    ("DATAX", ("type_convert", "data_transform")): ("检查源表和目标表的字段类型是否匹配",),
    ("DATAX", ("column_not_match",)): ("检查列名配置是否与实际表结构一致",),
    ("DATAX", ("primary_key_conflict",)): ("考虑数据去重或使用 REPLACE INTO 模式",),
}


def with_suggestions(results: DataFrame) -> DataFrame:
    """results (task_type, error_type) with the array `suggestions`, empty where there is none. The table has some forty rows."""
    rows = [(kind, e, list(texts)) for (kind, errors), texts in SUGGESTIONS.items() for e in errors]
    table = results.sparkSession.createDataFrame(rows, "task_type string, error_type string, suggestions array<string>")
    out = results.join(F.broadcast(table), ["task_type", "error_type"], "left")
    return out.withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))


def _facts(**values: Column) -> Column:
    """A map of the values that aren't null, as text."""
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())


def diagnose(alerts: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row for each alert (alert_id, task_type, text): COLUMNS, with no facts yet.

    A rule is matched with the log's ranked error blocks, after what diagnostics say of killed containers; an alert
    without blocks stays UNKNOWN and asks for a deep analysis.
    """
    texts = alerts.select(F.col("alert_id").alias("log_id"), "task_type", F.coalesce("text", F.lit("")).alias("text"))
    blocks = logs.ranked(logs.first_of_type(logs.error_blocks(logs.lines(texts))))
    by = blocks.groupBy("log_id").agg(
        F.count("*").alias("n_blocks"),
        F.max(F.when(F.col("rank") == 1, logs.root_cause(F.col("block")))).alias("root_cause"),
        F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("_b")
    )
    by = by.withColumn("blocks", F.transform("_b", lambda x: x.block)).drop("_b")
    base = texts.join(by, "log_id", "left").fillna(0, ["n_blocks"]).withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>")))
    shown = F.concat_ws("\n", diagnostics_tail(F.col("text")), F.array_join("blocks", "\n\n"))
    matched = match.match_rules(base.select("log_id", "task_type", shown.alias("text")), patterns)
    out = base.select("log_id", "n_blocks", "blocks", "root_cause").join(matched, "log_id").withColumnRenamed("log_id", "alert_id")
    deep = needs_deep_analysis(F.col("n_blocks"), F.col("category"), F.col("error_type"))
    none = F.from_json(F.lit("{}"), "map<string, string>")
    return out.withColumns(
        {"error_class": error_class(F.col("error_type")), "risk": skill_risk(F.col("category")), "needs_deep": deep, "facts": none}
    ).select(*COLUMNS)


def _with_facts(results: DataFrame, facts: DataFrame) -> DataFrame:
    """results with the facts (alert_id, found) of those that have any."""
    return results.join(facts, "alert_id", "left").withColumn("facts", F.coalesce("found", F.col("facts"))).select(*COLUMNS)


def spark_skill(patterns: DataFrame, diagnostics: DataFrame, stages: DataFrame, executors: DataFrame, tasks: DataFrame) -> Skill:
    """Alerts with `app`: rules, and for those that ask for a deep analysis, and for no others, what the event log adds.

    diagnostics(app, text), and stages, executors and tasks that failed as (app, ord, text).
    """

    def analyse(alerts: DataFrame) -> DataFrame:
        found = diagnose(alerts, patterns).join(alerts.select("alert_id", "app"), "alert_id")
        deep = found.filter("needs_deep")
        apps = deep.filter("app IS NOT NULL").select("app").distinct()
        wanted = [x.join(apps, "app", "left_semi") for x in (diagnostics, stages, executors, tasks)]
        return with_evidence(deep, *wanted).select(*COLUMNS).unionByName(found.filter("NOT needs_deep").select(*COLUMNS))

    return analyse


def python_skill(patterns: DataFrame) -> Skill:
    """Rules, and the type, message and deepest frame of the traceback."""

    def analyse(alerts: DataFrame) -> DataFrame:
        whole = alerts.select(F.col("alert_id").alias("log_id"), F.lit(1).alias("pos"), F.coalesce("text", F.lit("")).alias("block"))
        c = F.col
        found = _facts(exception=c("type"), message=c("message"), file=c("deepest.file"), line=c("deepest.line"), function=c("deepest.function"))
        return _with_facts(diagnose(alerts, patterns), logs.python_tracebacks(whole).select(c("log_id").alias("alert_id"), found.alias("found")))

    return analyse


def shell_skill(patterns: DataFrame) -> Skill:
    """Rules, and the first error that the shell reports, with the script's line."""

    def analyse(alerts: DataFrame) -> DataFrame:
        errors = logs.shell_errors(logs.lines(alerts.select(F.col("alert_id").alias("log_id"), "text")))
        first = errors.groupBy(F.col("log_id").alias("alert_id")).agg(F.min(F.struct("line_no", "type", "script_line")).alias("e"))
        found = _facts(error=F.col("e.type"), log_line=F.col("e.line_no"), script_line=F.col("e.script_line"))
        return _with_facts(diagnose(alerts, patterns), first.select("alert_id", found.alias("found")))

    return analyse


def sync_skill(patterns: DataFrame) -> Skill:
    """Rules, and database, host, job, channels, reader and writer of a data-sync log."""

    def analyse(alerts: DataFrame) -> DataFrame:
        f = sync_facts(F.coalesce("text", F.lit("")))
        found = _facts(**{k: f[k] for k in ("database", "host", "job_id", "channels", "reader", "writer")})
        return _with_facts(diagnose(alerts, patterns), alerts.select("alert_id", found.alias("found")))

    return analyse


def _followed(alerts: DataFrame, patterns: DataFrame, error_type: Column, found: DataFrame) -> DataFrame:
    """Alerts whose cause lies elsewhere: the error type is given, and a person or a model looks on from there."""
    base = diagnose(alerts, patterns).join(alerts.select("alert_id", error_type.alias("_type")), "alert_id")
    deep = needs_deep_analysis(F.col("n_blocks"), F.lit("KNOWN_NEEDS_LLM"), F.col("_type"))
    base = base.withColumns(
        {
            "category": F.lit("KNOWN_NEEDS_LLM"),
            "error_type": F.col("_type"),
            "hint": F.lit(None).cast("string"),
            "error_class": error_class(F.col("_type")),
            "risk": F.lit("HIGH"),
            "needs_deep": deep
        }
    )
    return _with_facts(base.select(*COLUMNS), found)


def dependent_skill(patterns: DataFrame, upstream: DataFrame) -> Skill:
    """Alerts of dependent tasks: a failed check or a timeout, what it waits for, and the upstream failure with its tasks.

    upstream(alert_id, instance_id, failed_tasks) comes from alerts.upstream_failures().
    """

    def analyse(alerts: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        waits = dependency_facts(text)
        told = alerts.select("alert_id", waits.alias("w")).join(upstream, "alert_id", "left")
        found = _facts(
            definitions=F.nullif(F.array_join("w.definitions", ","), F.lit("")),
            projects=F.nullif(F.array_join("w.projects", ","), F.lit("")),
            cycle=F.col("w.cycle"),
            instance=F.col("instance_id"),
            failed_tasks=F.array_join("failed_tasks", ",")
        )
        kind = F.when(F.lower(text).contains("timeout"), "dependent_waiting_timeout").otherwise("dependent_check_failed")
        return _followed(alerts, patterns, kind, told.select("alert_id", found.alias("found")))

    return analyse


def sub_process_skill(patterns: DataFrame, failures: DataFrame) -> Skill:
    """Alerts of sub-workflow tasks: the called definition and the failed tasks of its instance.

    failures(alert_id, child_instance_id, task) comes from alerts.sub_workflow_failures().
    """

    def analyse(alerts: DataFrame) -> DataFrame:
        by = failures.groupBy("alert_id").agg(
            F.max("child_instance_id").alias("child"),
            F.array_join(F.array_sort(F.collect_set("task")), ",").alias("tasks")
        )
        code = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), r'"processDefinitionCode"\s*:\s*(\d+)', 1), F.lit(""))
        told = alerts.select("alert_id", code.alias("definition")).join(by, "alert_id", "left")
        found = _facts(definition=F.col("definition"), instance=F.col("child"), failed_tasks=F.col("tasks"))
        return _followed(alerts, patterns, F.lit("sub_workflow_failed"), told.select("alert_id", found.alias("found")))

    return analyse


def timeout_skill(patterns: DataFrame, metrics: DataFrame) -> Skill:
    """Alerts (with workflow) of what ran too long: the kind of timeout by the first rule that holds, and advice.

    metrics(workflow, and what runs.timeout_class() names, and running).
    """

    def analyse(alerts: DataFrame) -> DataFrame:
        kinds = runs.timeout_advice(runs.timeout_class(metrics))
        rows = alerts.join(
            kinds.select("workflow", "timeout_type", "confidence", "advice"),
            "workflow",
            "left"
        ).withColumn("timeout_type", F.coalesce("timeout_type", F.lit("unknown")))
        found = rows.select("alert_id", _facts(confidence=F.col("confidence"), advice=F.col("advice")).alias("found"))
        return _followed(rows, patterns, F.col("timeout_type"), found)

    return analyse


def skills(patterns: DataFrame, **others: Skill) -> Skills:
    """A registry: shell, Python and data-sync tasks by their skills, other types by `others`, such as SPARK=spark_skill(...);
    any type that is left is diagnosed as shell tasks are."""
    shell = shell_skill(patterns)
    found = Skills(lambda df: shell(df.withColumn("task_type", F.lit("SHELL"))))
    if "SPARK" not in others:
        found.register(("SPARK",), lambda df: diagnose(df, patterns))
    for task_type, skill in {"SHELL": shell, "PYTHON": python_skill(patterns), "DATAX": sync_skill(patterns), **others}.items():
        found.register((task_type,), skill)
    return found


def first_actions(results: DataFrame, fixes: DataFrame, most: int = 3) -> DataFrame:
    """(alert_id, ord, action): the fix of an alert, if fixes(alert_id, fix) has one, then suggestions, `most` in all."""
    rows = with_suggestions(results).join(fixes, "alert_id", "left")
    listed = F.slice(F.concat(F.array_compact(F.array("fix")), F.slice("suggestions", 1, most - 1)), 1, most)
    return rows.select("alert_id", F.posexplode(listed).alias("ord", "action"))

