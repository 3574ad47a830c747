"""Queries of facts in texts. Each text is put together from columns of a table, so that SQL over these columns says what is
to be found in it."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import logs
from .bindings import view
from .registry import query


def _said(*parts):
    """A text of literals and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _events(s, d, **texts):
    return view(s, d, "events").select("event_id", *(c.alias(k) for k, c in texts.items()))


def J(c, by=","):
    return F.array_join(c, by)


def _ids():
    return F.col("event_id"), F.col("user_id")


@query(
    """SELECT event_id, concat_ws(',', 'hdfs://nn:8020/a/' || user_id, '10.0.' || user_id % 256 || '.7:' || (1000 + event_id % 60000), CASE WHEN event_id % 2 = 0 THEN 'db-' || user_id || '.local:3306' END) AS found FROM events"""
)
def log_targets(s, d):
    E, U = _ids()
    line = _said(
        "read hdfs://nn:8020/a/",
        U,
        " from 10.0.",
        U % 256,
        ".7:",
        E % 60000 + 1000,
        " and 300.1.1.1:80, again 10.0.",
        U % 256,
        ".7:",
        E % 60000 + 1000,
        F.when(E % 2 == 0, _said(" at db-", U, ".local:3306")).otherwise(F.lit(" at host:99999"))
    )
    return _events(s, d, found=J(text.targets(line)))


@query("""SELECT event_id, 'oss://bucket/warehouse/long/path/dt=2024-01-' || day || ',/warehouse/long/path/dt=2024-01-' || day || ',hdfs://nn/data/t' || u || ',/user/hive/x' || e || ',/data/t' || u AS paths
FROM (SELECT event_id, lpad(CAST(user_id % 28 + 1 AS VARCHAR), 2, '0') AS day, lpad(CAST(user_id AS VARCHAR), 8, '0') AS u, lpad(CAST(event_id AS VARCHAR), 8, '0') AS e FROM events)""")
def log_paths(s, d):
    E, U = _ids()
    line = _said(
        "in /user/hive/x",
        F.lpad(E.cast("string"), 8, "0"),
        " and hdfs://nn/data/t",
        F.lpad(U.cast("string"), 8, "0"),
        " or oss://bucket/warehouse/long/path/dt=2024-01-",
        F.lpad((U % 28 + 1).cast("string"), 2, "0"),
        " but /tmp/a"
    )
    return _events(s, d, paths=J(text.storage_paths(line)))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'oracle' ELSE 'postgresql' END AS "database", 'db-' || user_id || ':33' AS host, sha256('u' || user_id) AS user_sha256, event_id AS job_id, event_id % 7 AS channels, CASE event_id % 3 WHEN 0 THEN 'mysqlreader' WHEN 1 THEN 'oraclereader' ELSE 'postgresqlreader' END AS reader, 'hdfswriter' AS writer FROM events"""
)
def sync_log_facts(s, d):
    E, U = _ids()
    name = F.element_at(F.array(*map(F.lit, ("mysql", "oracle", "postgresql"))), (E % 3 + 1).cast("int"))
    line = _said("jdbc:", name, "://db-", U, ":33/x username='u", U, "' jobId: ", E, " channel=", E % 7, " ", name, "Reader HdfsWriter")
    return _events(s, d, f=text.sync_facts(line)).select("event_id", "f.*")


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'hdfs:/warehouse/t' || user_id WHEN 1 THEN 'hdfs:/warehouse/t' || user_id WHEN 2 THEN 'db.t' || user_id ELSE 'mysql:shop.t' || user_id END AS inputs, 'mysql:shop.o' || event_id AS outputs FROM events"""
)
def sync_job_tables(s, d):
    E, U = _ids()
    hdfs = _said('{"name": "hdfsreader", "parameter": {"path": "/warehouse/t', U, F.when(E % 4 == 0, "/dt=2024-01-01").otherwise(""), '"}}')
    hive = _said('{"name": "hivereader", "parameter": {"database": "db", "table": "t', U, '"}}')
    mysql = lambda side, c: _said(f'{{"name": "mysql{side}", "parameter": {{"database": "shop", "table": ["', c, '", "more"]}}')
    reader = F.when(E % 4 < 2, hdfs).when(E % 4 == 2, hive).otherwise(mysql("reader", _said("t", U)))
    job = _said('{"job": {"content": [{"reader": ', reader, ', "writer": ', mysql("writer", _said("o", E)), "}]}}")
    return _events(s, d, t=text.sync_tables(job)).select("event_id", J("t.inputs").alias("inputs"), J("t.outputs").alias("outputs"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'com.x.Job' || user_id WHEN 1 THEN 'com.y.Job' || user_id END AS main_class, 'jar-' || user_id AS jar_project, 'team' || user_id AS package, 'com/own/team' || user_id || '/J.scala,com/own/team' || user_id || '/J.java,com/own/team' || user_id || '/J.py' AS paths FROM events"""
)
def code_names(s, d):
    E, U = _ids()
    params = F.when(
        E % 3 == 0,
        _said('{"mainClass": "com.x.Job', U, '", "args": "--class z.Z"}')
    ).when(E % 3 == 1, _said('{"args": "--class com.y.Job', U, ' --x"}')).otherwise(F.lit("{}"))
    jar, name = _said(
        "s3://b/jar-",
        U,
        "-1.2.3",
        F.when(E % 2 == 0, "-SNAPSHOT").otherwise(""),
        "-jar-with-dependencies.jar"
    ), _said("com.own.team", U, ".J$Inner")
    return _events(
        s,
        d,
        main_class=text.main_class(params),
        jar_project=text.jar_project(jar),
        package=text.class_project(name, "com.own"),
        paths=J(text.class_paths(name))
    )


@query(
    r"""SELECT event_id, substr('task ' || event_id || ' failed at /data/x' || repeat('y', user_id % 120), 1, 100) AS excerpt, CASE WHEN length(substr('task ' || event_id || ' failed at /data/x' || repeat('y', user_id % 120), 1, 100)) <= 50 THEN 'task \d+ failed at .*' ELSE substr('task ' || event_id || ' failed at /data/x' || repeat('y', user_id % 120), 1, 100) END AS pattern FROM events""".replace(r"\d", "' || chr(92) || 'd")
)
def log_excerpts(s, d):
    E, U = _ids()
    line = _said("2024-01-01 10:00:00,123 [ERROR] task ", E, " failed at /data/x", F.repeat(F.lit("y"), (U % 120).cast("int")))
    short = text.excerpt(line)
    return _events(s, d, excerpt=short, pattern=text.generalised(short))


@query(
    """SELECT event_id, round(greatest(event_id % 500, CASE event_id % 4 WHEN 0 THEN user_id / 1024.0 WHEN 1 THEN user_id WHEN 2 THEN user_id * 1024 ELSE user_id / 1048576.0 END), 6) AS mb FROM events"""
)
def broadcast_sizes(s, d):
    E, U = _ids()
    unit = F.element_at(F.array(*map(F.lit, ("KB", "MB", "GB", "bytes"))), (E % 4 + 1).cast("int"))
    line = _said("BroadcastExchange: broadcast size = ", E % 500, " MB\nBuild relation size: ", U, " ", unit)
    return _events(s, d, mb=F.round(text.broadcast_mb(line), 6))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'BroadcastHashJoin,SortMergeJoin' WHEN 1 THEN 'SortMergeJoin' WHEN 2 THEN 'BroadcastHashJoin,SortMergeJoin' ELSE '' END AS strategies FROM events"""
)
def join_strategies(s, d):
    E, _ = _ids()
    line = F.when(
        E % 4 == 0,
        "Choosing join strategy: BroadcastHashJoin\nChoosing join strategy = SortMergeJoin"
    ).when(E % 4 == 1, "Choosing join strategy: SortMergeJoin, not BroadcastHashJoin").when(E % 4 == 2, "+- SortMergeJoin [k]\n+- BroadcastHashJoin [k]").otherwise("scan")
    return _events(s, d, strategies=J(text.join_strategies(line)))


@query(
    """SELECT event_id, event_id % 3 AS broadcasts, event_id % 2 AS merges, 'a.t' || user_id || CASE WHEN event_id % 2 = 0 THEN ',b.t' ELSE '' END AS scans FROM events"""
)
def plan_facts(s, d):
    E, U = _ids()
    plan = _said(
        F.repeat(F.lit("+- BroadcastHashJoin\n"), (E % 3).cast("int")),
        F.repeat(F.lit("+- SortMergeJoin\n"), (E % 2).cast("int")),
        "FileScan parquet a.t",
        U,
        "\nFileScan parquet a.t",
        U,
        F.when(E % 2 == 0, "\nScan hive b.t").otherwise("")
    )
    c = text.plan_counts(plan)
    return _events(s, d, broadcasts=c["BroadcastHashJoin"], merges=c["SortMergeJoin"], scans=J(c["scans"]))


@query(
    """SELECT event_id, '12' || user_id AS definitions, '3' AS projects, CASE WHEN event_id % 2 = 0 THEN 'day' END AS cycle, CASE WHEN event_id % 2 = 0 THEN 'last' || event_id % 9 || 'Days' END AS date_value FROM events"""
)
def dependency_log_facts(s, d):
    E, U = _ids()
    q = F.lit('\\"')
    line = _said(
        "{",
        q,
        "definitionCode",
        q,
        ": 12",
        U,
        ", ",
        q,
        "projectCode",
        q,
        ": 3, ",
        q,
        "depTaskCode",
        q,
        ":0",
        F.when(
            E % 2 == 0,
            _said(", ", q, "cycle", q, ": ", q, "day", q, ", ", q, "dateValue", q, ": ", q, "last", E % 9, "Days", q)
        ).otherwise(F.lit("")),
        "}"
    )
    return _events(s, d, f=text.dependency_facts(line)).select(
        "event_id",
        J("f.definitions").alias("definitions"),
        J("f.projects").alias("projects"),
        "f.cycle",
        "f.date_value"
    )


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Container killed by YARN ' || event_id WHEN 1 THEN 'out of Memory in ' || user_id END AS tail FROM events"""
)
def diagnostics_tails(s, d):
    E, U = _ids()
    line = F.when(
        E % 3 == 0,
        _said("app failed\n[YARN Diagnostics]\nContainer killed by YARN ", E)
    ).when(E % 3 == 1, _said("[YARN Diagnostics]\nout of Memory in ", U)).otherwise("[YARN Diagnostics]\nuser asked")
    return _events(s, d, tail=text.diagnostics_tail(line))


# Logs of documents: the whole text, or a head and a tail of what is over 5,000 characters.
@query(
    """SELECT doc_id, md5(CASE WHEN length(t) > 5000 THEN substr(t, 1, 2000) || chr(10) || '...' || chr(10) || right(t, 3000) ELSE t END) AS head_tail, md5(t) AS "full", md5('b1' || chr(10) || chr(10) || substr(t, 1, 500)) AS smart FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 100000) AS t FROM documents)"""
)
def log_extracts(s, d):
    t, none = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    shown = {"head_tail": (none, "head_tail"), "full": (none, "full"), "smart": (F.array(F.lit("b1")), "smart")}
    return view(s, d, "documents").select("doc_id", *(F.md5(text.log_excerpt(t, b, how)).alias(k) for k, (b, how) in shown.items()))


@query(
    """SELECT CAST(user_id AS VARCHAR) AS app, 'container_1_' || lpad(CAST(n AS VARCHAR), 6, '0') AS container FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n BETWEEN 2 AND 4"""
)
def executor_containers(s, d):
    _, U = _ids()
    n = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY event_id)")
    c = view(s, d, "events").withColumn("n", n).select(
        U.cast("string").alias("app"),
        _said("container_1_", F.lpad(F.col("n").cast("string"), 6, "0")).alias("container")
    )
    return logs.executor_containers(c)


def _log_lines(s, d, *lines):
    """The lines of a log for each event."""
    E, _ = _ids()
    body = F.array_join(F.array(*lines), "\n", "")
    return logs.lines(view(s, d, "events").select(E.alias("log_id"), body.alias("text")))


@query(
    """SELECT event_id AS log_id, k + 1 AS line_no, CASE k WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'lost' ELSE 'heartbeat_timeout' END AS event, user_id % 50 + k AS executor, CASE k WHEN 1 THEN 'lost ' || event_id END AS reason FROM events, (SELECT unnest(range(4)) AS k) WHERE k < 1 + event_id % 4"""
)
def executor_log_events(s, d):
    E, U = _ids()
    x = lambda k: U % 50 + k
    made = [
        _said("INFO Added executor ", x(0), " with 4 cores"),
        _said("Removed executor ", x(1), ": lost ", E),
        _said("ERROR Executor ", x(2), " lost"),
        _said("Executor ", x(3), " heartbeat timeout after 120 s")
    ]
    return logs.executor_events(_log_lines(s, d, *(F.when(E % 4 >= k, line).otherwise("-") for k, line in enumerate(made))))


@query(
    """SELECT event_id AS log_id, CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'completed' ELSE 'failed' END AS status, CASE event_id % 5 WHEN 1 THEN user_id / 1000.0 WHEN 3 THEN user_id * 60.0 END AS duration_s, CASE event_id % 5 WHEN 2 THEN 'Task ' || user_id || ' failed 4 times' WHEN 4 THEN 'lost' END AS reason FROM events"""
)
def stage_states(s, d):
    E, U = _ids()
    last = F.when(E % 5 == 1, _said("Stage 3 finished in ", U, " ms")).when(
        E % 5 == 2,
        _said("Stage 3 failed: Task ", U, " failed 4 times")
    ).when(E % 5 == 3, _said("Stage 3 completed, duration = ", U, " min")).when(E % 5 == 4, "Stage 3 failed, lost").otherwise("-")
    return logs.stage_times(_log_lines(s, d, F.lit("Stage 3 started"), last)).select("log_id", "status", "duration_s", "reason")


@query(
    """SELECT event_id AS log_id, CASE event_id % 4 WHEN 0 THEN 'syntax_error' WHEN 1 THEN 'command_not_found' WHEN 2 THEN 'permission_denied' ELSE 'file_not_found' END AS type, CASE WHEN event_id % 2 = 0 THEN user_id END AS script_line FROM events"""
)
def shell_errors(s, d):
    E, U = _ids()
    what = F.element_at(
        F.array(*map(F.lit, ("syntax error near x", "foo: command not found", "/x: Permission denied", "No such file or directory"))),
        (E % 4 + 1).cast("int")
    )
    return logs.shell_errors(
        _log_lines(s, d, F.lit("start"), _said("run.sh: ", F.when(E % 2 == 0, _said("line ", U, ": ")).otherwise(F.lit("")), what))
    ).select("log_id", "type", "script_line")


@query(
    """SELECT event_id AS log_id, 'org.x.E' || user_id % 7 || 'Exception' AS type, 'boom ' || event_id AS message, CASE WHEN event_id % 2 = 0 THEN 'java.io.IOException: disk' ELSE 'org.x.E' || user_id % 7 || 'Exception: boom ' || event_id END AS root_cause, 'a.b.C.run:' || user_id AS frames FROM events"""
)
def jvm_exceptions(s, d):
    E, U = _ids()
    found = logs.jvm_exceptions(
        logs.error_blocks(
            _log_lines(
                s,
                d,
                F.lit("INFO x"),
                _said("org.x.E", U % 7, "Exception: boom ", E),
                _said("\tat a.b.C.run(C.java:", U, ")"),
                F.when(E % 2 == 0, "Caused by: java.io.IOException: disk").otherwise("\t... 3 more")
            )
        )
    )
    frame = F.transform("frames", lambda f: F.concat_ws(":", F.concat_ws(".", f["class"], f["method"]), f["line"].cast("string")))
    return found.select("log_id", "type", "message", "root_cause", J(frame).alias("frames"))


@query(
    """SELECT event_id AS log_id, CASE event_id % 2 WHEN 0 THEN 'KeyError' ELSE 'ValueError' END AS type, 'k' || user_id AS message, 'b.py:' || event_id || ':go' AS deepest, 2 AS n_frames FROM events"""
)
def python_tracebacks(s, d):
    E, U = _ids()
    block = F.array_join(
        F.array(
            F.lit("Traceback (most recent call last):"),
            F.lit('  File "a.py", line 1, in <module>'),
            F.lit("    go()"),
            _said('  File "b.py", line ', E, ", in go"),
            _said(F.when(E % 2 == 0, "KeyError").otherwise("ValueError"), ": k", U)
        ),
        "\n"
    )
    found = logs.python_tracebacks(view(s, d, "events").select(E.alias("log_id"), F.lit(1).alias("pos"), block.alias("block")))
    return found.select(
        "log_id",
        "type",
        "message",
        F.concat_ws(":", "deepest.file", F.col("deepest.line").cast("string"), "deepest.function").alias("deepest"),
        F.size("frames").cast("long").alias("n_frames")
    )


@query("""SELECT event_id AS log_id, event_id % 4 <> 3 AS is_useful FROM events""")
def useful_logs(s, d):
    E, U = _ids()
    line = F.when(E % 4 == 0, "ERROR x").when(E % 4 == 1, "spark.executor.memory = 4g").when(
        E % 4 == 2,
        _said("application_1700000000000_", F.lpad(U.cast("string"), 4, "0"))
    ).otherwise("hello")
    return logs.useful(_log_lines(s, d, line)).select("log_id", "is_useful")


@query(
    """SELECT event_id AS log_id, CASE WHEN event_id % 3 = 0 THEN '8g' ELSE user_id || 'm' END AS executor_memory, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS executor_instances FROM events"""
)
def log_settings(s, d):
    E, U = _ids()
    made = _log_lines(
        s,
        d,
        _said("--conf spark.executor.memory=", U, "m"),
        F.when(E % 3 == 0, "spark.executor.memory: 8g").otherwise("at x.y.spark.executor.memory=1g(Z.java:1)"),
        F.when(E % 3 == 0, _said("spark.executor.instances=", U)).otherwise(F.lit("import spark.executor.memory=9g"))
    )
    return logs.current_config(logs.config_lines(made)).select("log_id", "executor_memory", "executor_instances")


_WORDS = (
    "java.lang.OutOfMemoryError",
    "GC overhead limit exceeded",
    "Memory limit exceeded",
    "Container killed",
    "Executor lost",
    "heartbeat timeout",
    "FetchFailedException",
    "Job aborted",
    "Task failed",
    "Stage failed",
    "Communications link failure",
    "Access denied",
    "Permission denied",
    "Duplicate entry",
    "exitStatusCode",
    "Exception x",
    "Error x",
    "FATAL x",
    "nothing"
)
_SCORES = (10, 10, 9, 9, 8, 8, 8, 7, 6, 6, 6, 5, 5, 5, 5, 4, 3, 2, 0)


@query(f"""SELECT event_id, {list(_SCORES)}[event_id % {len(_WORDS)} + 1] AS score FROM events""")
def block_scores(s, d):
    E, _ = _ids()
    word = F.get(F.array(*map(F.lit, _WORDS)), (E % len(_WORDS)).cast("int"))
    return _events(s, d, score=logs.score(_said("line ", E, " ", word)))


@query(
    """SELECT event_id, ['java.io.IOException', 'org.apache.Job', 'com.mysql.Driver', 'KeyError', 'permission denied', 'connection refused', 'no such file', 'command not found', 'process has exited', 'exitstatuscode', 'unknown'][event_id % 11 + 1] AS type FROM events"""
)
def exception_types(s, d):
    E, _ = _ids()
    said = (
        "x java.io.IOException: y",
        "org.apache.Job z",
        "com.mysql.Driver",
        "KeyError: 'k'",
        "x: Permission denied",
        "Connection refused",
        "No such file or directory",
        "foo: command not found",
        "process has exited with 1",
        "exitStatusCode = 1",
        "hello"
    )
    return _events(s, d, type=logs.exception_type(F.get(F.array(*map(F.lit, said)), (E % 11).cast("int"))))


_WARNED = (
    "GC overhead limit exceeded",
    "shuffle fetch failed, retry 3",
    "Low memory",
    "Skew detected in stage",
    "task timeout",
    "job stuck",
    "all is well",
    "retry"
)


@query("""SELECT event_id AS log_id FROM events WHERE event_id % 8 < 6""")
def critical_warnings(s, d):
    E, _ = _ids()
    return logs.critical_warnings(_log_lines(s, d, F.lit("INFO x"), F.get(F.array(*map(F.lit, _WARNED)), (E % 8).cast("int")))).select("log_id")
