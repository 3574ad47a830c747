"""Operators on small hand-made inputs, with the boundary cases of each rule."""

import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import alerts, graph, lineage, logs, match, review, runs
from tracelake.sources import files


def one(spark, **values):
    """A row of expressions over literal columns."""
    return spark.range(1).select(*(c.alias(k) for k, c in values.items())).first()


def test_sql_text(spark):
    cases = {
        "INSERT OVERWRITE TABLE a.b SELECT * FROM c.d JOIN e.f x ON 1=1": (["a.b"], ["c.d", "e.f"]),
        "WITH q AS (SELECT * FROM s.t), r AS (SELECT 1) INSERT INTO w.x SELECT * FROM q LEFT JOIN r ON 1=1": (["w.x"], ["s.t"]),
        "SELECT * FROM (SELECT 1) z": ([], []),
        "": ([], []),
    }
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    for r in df.select("q", text.sql_targets(F.col("q")).alias("o"), text.sql_sources(F.col("q")).alias("i")).collect():
        assert (r["o"], sorted(r["i"])) == cases[r["q"]]


def test_embedded_sql(spark):
    cases = [(".sql", "select 1", 1), (".scala", 'val q = """\nSELECT *\n FROM t"""; val s = "no"', 1), (".java", 'String s = "INSERT INTO x.y SELECT 1";', 1), (".py", "q = '''select a from b'''\nr = 'delete from c'", 2), (".txt", "select 1", 0)]
    df = spark.createDataFrame(cases, "e string, c string, n int")
    assert all(len(r["q"]) == r["n"] for r in df.select("n", text.embedded_sql(F.col("e"), F.col("c")).alias("q")).collect())


def test_sync_tables(spark):
    job = {"job": {"content": [{"reader": {"name": "hdfsreader", "parameter": {"path": "/a/b/dt=1/c"}}, "writer": {"name": "mysqlwriter", "parameter": {"connection": [{"table": ["t1", "t2"]}]}}}]}}
    r = one(spark, t=text.sync_tables(F.lit(json.dumps(job))))["t"]
    assert r["inputs"] == ["hdfs:/a/b/c"] and r["outputs"] == ["mysql:t1"]


def test_sizes_paths_and_ids(spark):
    r = one(
        spark,
        a=text.memory_mb(F.lit("1.5g")), b=text.memory_text(F.lit(1536)), c=text.memory_text_whole(F.lit(1536)), d=text.memory_text(F.lit(4096)),
        e=text.partition_date(F.lit("/w/t/2024/03/05/x.parquet")).cast("string"), f=text.partition_base(F.lit("/w/t/dt=2024-03-05/x")), g=text.partition_date(F.lit("/w/t/x")).cast("string"), p=text.partition_path(F.lit("/w/t/"), F.lit("2024-03-05").cast("date")), q=text.partition_date(F.lit("/w/date=20240305/x")).cast("string"),
        h=text.application_id(F.lit("x app-20240101-0001 y")), i=text.targets(F.lit("at 10.0.0.1:8020 and 999.1.1.1:80 node-1:9000 host:99999")),
        j=text.jar_project(F.lit("s3://b/my-proj-1.2.3-jar-with-dependencies.jar")), k=text.generalised(F.lit("lost 12 in /tmp/a")), m=text.join_strategies(F.lit("Choosing join strategy: SortMergeJoin")),
        n=text.broadcast_mb(F.lit("BroadcastExchange: broadcast size = 256.0 MB\nBuild relation size: 1 GB")), o=text.main_class(F.lit("--class a.b.C --conf x")),
    )
    assert (r["a"], r["b"], r["c"], r["d"]) == (1536, "1.5g", "1536m", "4g")
    assert (r["e"], r["f"], r["g"], r["h"]) == ("2024-03-05", "/w/t", None, "app-20240101-0001")
    assert "10.0.0.1:8020" in r["i"] and "node-1:9000" in r["i"] and not any(x.startswith("999") or x.endswith("99999") for x in r["i"])
    assert (r["j"], r["k"], r["n"], r["o"]) == ("my-proj", r"lost \d+ in .*", 1024.0, "a.b.C")
    assert r["m"] == ["SortMergeJoin"] and (r["p"], r["q"]) == ("/w/t/dt=2024-03-05/", "2024-03-05")


LOG = """INFO start
ERROR Executor: boom
java.lang.OutOfMemoryError: heap
\tat a.b.C.run(C.java:10)
Caused by: java.io.IOException: disk
\tat a.b.D.go(D.java:7)

Traceback (most recent call last):
  File "x.py", line 3, in f
ValueError: bad
all done"""


def plain_blocks(text):
    """Error blocks line by line: what is open, and how long it is."""
    any_of = lambda patterns, line, flags=0: any(re.search(p, line, flags) for p in patterns)
    done, block = [], None
    for line in text.split("\n"):
        bare = line.strip()
        caused, starts = bare.startswith("Caused by:"), any_of(logs.STARTS, bare, re.IGNORECASE)
        if bare and starts and not (caused and block is not None):
            done += [block] if block else []
            block = [line]
        elif bare and block is not None and (caused or any_of(logs.CONTINUES, bare)):
            block.append(line)
        elif bare and block is not None and len(block) >= 30:
            continue
        elif bare and block is not None and bare.startswith(logs.SOFT):
            block.append(line)
        elif block is not None:
            done.append(block)
            block = None
    return ["\n".join(b) for b in done + ([block] if block else [])]


def test_error_blocks_of_any_length_match_plain_code(spark):
    rnd = random.Random(1)
    kinds = ["ERROR a", "Caused by: x.Exception y", "Caused by: plain", "  at a.b(C.java:1)", "info", "", "java.io.IOException: z", "Timeout", "The last packet", "More", "\t... 3 more", "Traceback (most recent call last)", "ls: x"]
    texts = ["\n".join(rnd.choices(kinds, weights, k=rnd.randint(0, 120))) for weights in ([1] * 13, [1, 2, 2, 60, 1, 0.3, 1, 2, 2, 2, 1, 0, 0], [0.3, 1, 3, 60, 1, 0.1, 0, 1, 1, 1, 0, 0, 0]) for _ in range(60)]
    texts.append("ERROR x\n" + "at y\n" * 29 + "info\nat z\njava.lang.X: late\nCaused by: w.Exception\ninfo\nCaused by: more\n\nCaused by: q.Exception")
    df = logs.lines(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "log_id string, text string"))
    got = {}
    for r in logs.error_blocks(df).orderBy("log_id", "pos").collect():
        got.setdefault(r["log_id"], []).append(r["block"])
    assert {str(k): b for k, t in enumerate(texts) if (b := plain_blocks(t))} == got
    assert max(b.count("\n") for bs in got.values() for b in bs) > 32


def test_error_blocks(spark):
    df = logs.lines(spark.createDataFrame([("a", LOG), ("b", ""), ("c", "fine")], "log_id string, text string"))
    blocks = logs.error_blocks(df)
    causes = {r["pos"]: r["c"] for r in blocks.select("pos", logs.root_cause(F.col("block")).alias("c")).collect()}
    assert causes == {2: "ERROR Executor: boom", 3: "java.io.IOException: disk", 8: "Traceback (most recent call last):", 10: "ValueError: bad"}
    summary = {r["log_id"]: (r["n_blocks"], r["n_unique"], r["root_cause"]) for r in logs.error_summary(df).collect()}
    assert summary == {"a": (4, 3, "java.io.IOException: disk"), "b": (0, 0, ""), "c": (0, 0, "")}
    r = logs.jvm_exceptions(blocks).first()
    assert (r["pos"], r["type"], r["message"], r["root_cause"]) == (3, "java.lang.OutOfMemoryError", "heap", "java.io.IOException: disk")
    assert [(x["class"], x["method"], x["file"], x["line"]) for x in r["frames"]] == [("a.b.C", "run", "C.java", 10), ("a.b.D", "go", "D.java", 7)]
    whole = spark.createDataFrame([("a", 1, LOG[LOG.index("Traceback") :])], "log_id string, pos int, block string")
    r = logs.python_tracebacks(whole).first()
    assert (r["type"], r["message"]) == ("ValueError", "bad") and [tuple(x) for x in r["frames"]] == [("x.py", 3, "f")] and tuple(r["deepest"]) == ("x.py", 3, "f")


def test_gaps_of_exactly_five_minutes_are_no_gaps(spark):
    rows = [("a", k, f"2024-01-01 10:{m:02d}:00 x") for k, m in enumerate((0, 5, 11, 22))] + [("b", 0, "10:00:00 x")]
    df = spark.createDataFrame(rows, "log_id string, line_no int, line string").withColumn("ts", logs.timestamp_of(F.col("line")))
    assert [r["gap_minutes"] for r in logs.silent_periods(df).orderBy("from_ts").collect()] == [6.0, 11.0]
    got = {r["log_id"]: (r["n_gaps"], r["has_progress"]) for r in logs.progress(df).collect()}
    assert got == {"a": (2, False), "b": (0, True)}


def test_executors_and_stages(spark):
    lines = ["Added executor 1 on h with 4 cores", "Removed executor 1: reason = heartbeat timeout", "Executor 2 lost", "Stage 3 started: 2024-01-01 10:00:00", "Stage 3 failed: Task 0 failed 4 times", "Stage 4 finished in 1500 ms"]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(lines)], "log_id string, line_no int, line string")
    assert [(r["event"], r["executor"]) for r in logs.executor_events(df).orderBy("line_no").collect()] == [("added", 1), ("removed", 1), ("lost", 2)]
    stages = {r["stage"]: r for r in logs.stage_times(df).collect()}
    assert stages[3]["status"] == "failed" and stages[3]["reason"] == "Task 0 failed 4 times" and stages[4]["duration_s"] == 1.5


def test_rules_by_rank_and_unusable_patterns(spark):
    rules = spark.createDataFrame([("S", "B", 2, 1, "late", "oops", ""), ("S", "A", 1, 9, "first", "OOPS|x", ""), ("S", "A", 1, 1, "broken", "(", "")], "task_type string, category string, category_rank int, ord int, error_type string, pattern string, hint string")
    usable, rejected = match.checked_catalogue(rules, match.valid_patterns(rules))
    assert [r["error_type"] for r in rejected.collect()] == ["broken"]
    texts = spark.createDataFrame([("1", "S", "an oops"), ("2", "S", "fine"), ("3", "T", "oops")], "log_id string, task_type string, text string")
    assert {r["log_id"]: r["error_type"] for r in match.match_rules(texts, usable).collect()} == {"1": "first", "2": "UNKNOWN", "3": "UNKNOWN"}


def test_services(spark):
    hosts = spark.createDataFrame([("10.0.0.1", "n1", "NameNode (8020), Web UI (9870)"), ("300.1.1.1", "bad", "X (1)")], "ip string, hostname string, services string")
    got = match.lookup_services(spark.createDataFrame([("10.0.0.1", 9870), ("10.0.0.1", 1)], "ip string, port int"), hosts).collect()
    assert {(r["port"], r["service"]) for r in got} == {(9870, "Web UI"), (1, None)}


def test_catalogue_keeps_bars_in_patterns(spark):
    md = ["## AUTO_FIXABLE", "| type | pattern | hint |", "|---|---|---|", "| oom | `a|b` | more |", "## Glossary", "| x | `y` | z |", "## KNOWN_NEEDS_LLM", "| p | `q` | r |"]
    df = spark.createDataFrame([("S", k, x) for k, x in enumerate(md)], "task_type string, line_no int, line string")
    assert [(r["error_type"], r["pattern"], r["hint"], r["category_rank"]) for r in files.parse_catalogue(df).orderBy("ord").collect()] == [("oom", "a|b", "more", 1), ("p", "q", "r", 2)]


def test_prediction_needs_three_successes(spark):
    row = lambda w, k, d, p: (w, datetime(2024, 1, k + 1), k, d, p, 0, 0, 4096, 10, True)
    five = [row("five", k, d, p) for k, (d, p) in enumerate([(5000, 3000), (6000, 3600), (4000, 2400), (5500, 3300), (4800, 2900)])]
    df = spark.createDataFrame(five + [row("two", k, 10, 5) for k in range(2)] + [row("three", k, 100, 60) for k in range(3)], "workflow string, day timestamp, run long, input_bytes_mb long, peak_memory_mb long, shuffle_read_mb long, shuffle_write_mb long, executor_memory_mb long, executor_instances long, success boolean")
    got = {r["workflow"]: r for r in runs.predict_memory(df, F.lit(10000)).collect()}
    assert [got[w]["confidence"] for w in ("two", "three", "five")] == ["LOW", "MEDIUM", "HIGH"]
    assert got["two"]["executor_memory_mb"] is None and got["three"]["executor_memory_mb"] == 7800 and 7000 < got["five"]["executor_memory_mb"] < 8500


def test_skew_ratio_of_exactly_three_is_none(spark):
    df = spark.createDataFrame([("a", 1, 10, 5), ("a", 1, 10, 5), ("a", 1, 30, 5), ("b", 1, 10, 1), ("b", 1, 10, 1), ("b", 1, 31, 9), ("c", 1, 0, 0)], "app string, stage int, duration long, input_bytes long")
    got = {r["app"]: r for r in runs.task_distribution(df).collect()}
    assert not got["a"]["is_skewed"] and got["b"]["is_skewed"] and got["b"]["n_input_skewed"] == 1 and not got["c"]["is_skewed"]


def test_event_log(spark):
    done = lambda **m: json.dumps({"Event": "SparkListenerTaskEnd", "Task Metrics": m})
    lines = [done(**{"Input Metrics": {"Bytes Read": 5}, "Memory Bytes Spilled": 2}), done(), "garbage", '{"bad', json.dumps({"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": 1, "Submission Time": 100}}), json.dumps({"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Completion Time": 150}}), json.dumps({"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 2, "Completion Time": 150}})]
    e = files.parse_events(spark.createDataFrame([("a", k, x) for k, x in enumerate(lines)], "app string, line_no long, line string"))
    total = runs.event_totals(e).first()
    assert (total["input_bytes"], total["spilled_bytes"], total["shuffle_read_bytes"], total["n_tasks"]) == (5, 2, 0, 2)
    assert [(r["stage"], r["state"], r["duration_ms"]) for r in runs.event_stages(e).collect()] == [(1, "completed", 50)]


def test_risk_boundaries(spark):
    rows = [("a", "recover-failed", 5), ("b", "recover-failed", 6), ("c", "recover-failed", 0), ("d", "delete", 0)]
    df = spark.createDataFrame(rows, "alert_id string, action_type string, n_downstream int").withColumns({"structural": F.lit(False), "multi_param": F.lit(False), "retry_count": F.lit(0)})
    got = {r["alert_id"]: (r["risk"], r["needs_approval"]) for r in alerts.alert_risk(df).collect()}
    assert got == {"a": ("MEDIUM", False), "b": ("HIGH", True), "c": ("LOW", False), "d": ("CRITICAL", True)}


def test_alert_messages(spark):
    raws = ['{"projectCode": 1, "processId": 5, "processName": "a-b-1-2", "taskType": "spark", "logPath": "/x/77.log", "rootProcessInstanceId": 4}', '[{"projectCode": 2}, {"projectCode": 3}]', '{"alerts": "[{\\"projectCode\\": 4}]"}']
    df = spark.createDataFrame([(x,) for x in raws], "raw string")
    got = {r["project_code"]: r for r in alerts.normalised(alerts.messages(df)).collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert (got["1"]["task_type"], got["1"]["task_instance_id"], got["1"]["workflow_name"], got["1"]["is_sub_workflow"]) == ("SPARK", "77", "a-b", True)
    assert got["2"]["task_type"] == "SHELL"
    words = spark.createDataFrame([("hello",), ('x "taskType": 1 "projectCode" : 2',), ('{"taskType": null}',), ('[{"projectCode": 2}]',), ('{"alerts": "[]"}',), ('{"taskCode": 1}',), ("[]",), (None,)], "t string")
    assert [r[0] for r in words.select(alerts.is_alert(F.col("t"))).collect()] == [False, True, True, True, True, False, False, False]
    assert [r[0] for r in words.select(alerts.is_request(F.col("t"))).collect()] == [False, False, True, False, False, True, False, False]


def test_skills_by_type(spark):
    skills = alerts.Skills(lambda df: df.withColumn("by", F.lit("default")))
    skills.register(("SPARK",), lambda df: df.withColumn("by", F.lit("spark")))
    got = skills.analyse(spark.createDataFrame([("1", "SPARK"), ("2", "SHELL"), ("3", None)], "id string, task_type string"))
    assert {r["id"]: r["by"] for r in got.collect()} == {"1": "spark", "2": "default", "3": "default"}


def test_definitions(spark):
    a = {"data": {"workflow": {"code": 1, "name": "w", "schedule": {"crontab": "0 0 * * *"}}, "tasks": [{"code": 10, "name": "t", "taskType": "SPARK", "taskParams": "{}"}, {"name": "lost"}], "relations": [{"preTaskCode": 0, "postTaskCode": 10}, {"preTaskCode": 10, "postTaskCode": 11}]}}
    b = {"workflowDefinition": {"code": 2, "name": "v"}, "taskDefinitionList": []}
    got = files.parse_definitions(spark.createDataFrame([("p", json.dumps(a)), ("p", json.dumps(b)), ("p", "bad")], "project_code string, response string"))
    assert {(r["code"], r["schedule_type"]) for r in got["workflows"].collect()} == {("1", "CRON"), ("2", "MANUAL")}
    assert [r["code"] for r in got["tasks"].collect()] == ["10"]
    assert {(r["source"], r["target"]) for r in got["edges"].collect()} == {("1", "10"), ("10", "11")}


def test_dependents_in_three_shapes(spark):
    shapes = ['{"processDefinitionCode": "1"}', '{"dependence": {"dependTaskList": [{"processDefinitionCode": "2"}]}}', '{"dependence": {"dependTaskList": [{"dependItemList": [{"definitionCode": "3"}]}]}}', "{}"]
    df = spark.createDataFrame([("p", str(k), "w", "DEPENDENT", x) for k, x in enumerate(shapes)], "project string, code string, workflow string, task_type string, params string")
    assert [(r["depends_on"], r["is_empty"]) for r in lineage.dependents(df).orderBy("code").collect()] == [(["1"], False), (["2"], False), (["3"], False), ([], True)]


def test_graph_with_cycle_and_depths(spark):
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "c", "d"), ("p", "d", "d"), ("q", "a", "z")], "project string, source string, target string")
    deep = {(r["source"], r["target"]): r["depth"] for r in graph.closure(edges).filter("project = 'p'").collect()}
    assert deep[("a", "d")] == 3 and ("a", "a") not in deep
    assert deep == {(r["source"], r["target"]): r["depth"] for r in graph.closure(edges, max_depth=50).filter("project = 'p'").collect()}
    assert sorted(tuple(r["cycle"]) for r in graph.cycles(edges, 10).collect()) == [("a", "b", "c"), ("d",)]


def test_reviews(spark):
    c = spark.createDataFrame([("s", "x", 0.9), ("s", "y", 0.2), ("s", "z", None)], "skill_name string, original_log string, confidence double")
    assert {r["original_log"] for r in review.new_candidates(c).collect()} == {"x", "z"}


def test_log_store_round_trip(spark, tmp_path):
    rows = [("2024-01-01", "w/1", "t", "driver", "text"), ("2024-01-02", "w/1", "t", "driver", ""), ("2024-01-03", "w", "t", "driver", "b")]
    df = spark.createDataFrame(rows, "dt string, workflow_code string, task_code string, source string, text string")
    files.write_logs(df, str(tmp_path / "logs"))
    back = spark.read.json(str(tmp_path / "logs"))
    assert {(r["workflow_code"], r["text"]) for r in back.collect()} == {("w_1", "text"), ("w", "b")}
    today = F.lit("2024-01-09").cast("date")
    assert files.retained(df, today).count() == 2 and files.n_dropped_days(df, today).first()[0] == 1
    assert [r["dt"] for r in files.latest_logs(df).filter("workflow_code = 'w/1'").collect()] == ["2024-01-02"]


def test_facts_in_logs(spark):
    r = one(
        spark,
        a=text.sync_facts(F.lit("jdbc:mysql://db-1:3306/x username=bob jobId: 7 channel=3 mysqlreader hdfswriter")),
        b=text.dependency_facts(F.lit('{\\"definitionCode\\": 12, \\"projectCode\\": 3, \\"depTaskCode\\": 0, \\"cycle\\": \\"day\\", \\"dateValue\\": \\"today\\"}')),
        c=text.class_project(F.lit("com.owner.sales.job.Main"), "com.owner"),
        d=text.executor_sequence(F.lit("container_1_1_01_000002")),
    )
    assert (r["a"]["database"], r["a"]["host"], r["a"]["job_id"], r["a"]["channels"], r["a"]["reader"], r["a"]["writer"]) == ("mysql", "db-1:3306", 7, 3, "mysqlreader", "hdfswriter")
    assert r["a"]["user_sha256"] != "bob" and r["b"]["definitions"] == ["12"] and (r["b"]["cycle"], r["b"]["date_value"]) == ("day", "today")
    assert (r["c"], r["d"]) == ("sales", 2)


def test_diagnosis(spark):
    from tracelake.operators import diagnosis

    rules = spark.createDataFrame([("SPARK", "AUTO_FIXABLE", 1, 1, "oom_executor", "OutOfMemory", "more"), ("SHELL", "AUTO_FIXABLE", 1, 1, "denied", "permission denied", "chmod")], "task_type string, category string, category_rank int, ord int, error_type string, pattern string, hint string")
    df = spark.createDataFrame([("1", "SPARK", LOG), ("2", "OTHER", "x.sh: Permission denied"), ("3", "SPARK", "fine"), ("4", "SHELL", None)], "alert_id string, task_type string, text string")
    got = {r["alert_id"]: r for r in diagnosis.skills(rules).analyse(df).collect()}
    assert got["2"]["facts"] == {"error": "permission_denied", "log_line": "1"} and got["2"]["task_type"] == "SHELL"
    assert (got["1"]["error_type"], got["1"]["risk"], got["1"]["error_class"]) == ("oom_executor", "LOW", "RESOURCE")
    assert got["2"]["error_type"] == "denied" and got["3"]["error_type"] == got["4"]["error_type"] == "UNKNOWN" and got["3"]["needs_deep"]


def test_containers_and_useful_logs(spark):
    c = spark.createDataFrame([("a", f"container_1_{k:06d}") for k in range(1, 7)], "app string, container string")
    assert sorted(r["container"][-1] for r in logs.executor_containers(c).collect()) == ["2", "3", "4"]
    df = logs.lines(spark.createDataFrame([("a", "ERROR x"), ("b", "hello"), ("c", "spark.x.y = 1")], "log_id string, text string"))
    assert {r["log_id"]: r["is_useful"] for r in logs.useful(df).collect()} == {"a": True, "b": False, "c": True}


def test_shortest_paths_follow_long_chains(spark):
    chain = [("p", str(k), str(k + 1)) for k in range(60)] + [("p", "60", "0")]
    edges = spark.createDataFrame(chain, "project string, source string, target string")
    seed = spark.createDataFrame([("p", "0")], "project string, source string")
    steps = {r["target"]: len(r["path"]) - 1 for r in graph.shortest_paths(edges, seed).collect()}
    assert steps == {str(k): k for k in range(1, 61)}
    assert graph.shortest_paths(edges, seed, 3).count() == 3


def test_task_distribution_gathers_no_inputs(spark):
    inputs = {"a": [5, 1, 9, 9, 2, None], "b": [7], "c": [3, 3, 40, 1], "d": [None, None]}
    rows = [(app, 1, str(k), 10, v) for app, values in inputs.items() for k, v in enumerate(values)]
    found = runs.task_distribution(spark.createDataFrame(rows, "app string, stage int, task string, duration long, input_bytes long"))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["app"]: (r["n_tasks"], r["median_input"], r["n_input_skewed"]) for r in found.collect()}
    assert got == {"a": (6, 9, 0), "b": (1, 7, 0), "c": (4, 3, 1), "d": (2, None, 0)}


def test_skills_of_every_type(spark):
    from tracelake.operators import diagnosis

    rules = spark.createDataFrame([("SPARK", "KNOWN_NEEDS_LLM", 2, 1, "shuffle_failed", "FetchFailed", "look"), ("SPARK", "AUTO_FIXABLE", 1, 2, "oom_executor", "OutOfMemory", "more"), ("PYTHON", "AUTO_FIXABLE", 1, 1, "key_error", "KeyError", "get")], "task_type string, category string, category_rank int, ord int, error_type string, pattern string, hint string")
    by_app = lambda rows: spark.createDataFrame(rows, "app string, ord int, text string")
    spark_skill = diagnosis.spark_skill(rules, spark.createDataFrame([("a1", "killed by YARN")], "app string, text string"), by_app([("a1", 2, "stage 2"), ("a1", 1, "stage 1"), ("a2", 1, "not asked for")]), by_app([("a1", 1, "executor 1")]), by_app([("a1", 1, "task 1")]))
    upstream = spark.createDataFrame([("6", "i9", ["t1", "t2"])], "alert_id string, instance_id string, failed_tasks array<string>")
    failures = spark.createDataFrame([("7", "c5", "t8"), ("7", "c5", "t7")], "alert_id string, child_instance_id string, task string")
    columns = "workflow string, util double, containers int, queue_used double, apps int, max_retry int, max_wait double, avg_wait double, max_duration double, avg_duration double, is_data_spike boolean, upstream_delay boolean, running int"
    metrics = spark.createDataFrame([("w1", 10.0, 1, 5.0, 1, 4, 1.0, 1.0, 1.0, 1.0, False, False, 3)], columns)
    skills = diagnosis.skills(rules, SPARK=spark_skill, DEPENDENT=diagnosis.dependent_skill(rules, upstream), SUB_PROCESS=diagnosis.sub_process_skill(rules, failures), TIMEOUT=diagnosis.timeout_skill(rules, metrics))
    rows = [
        ("1", "SPARK", "ERROR FetchFailed x", "a1", None), ("2", "SPARK", "ERROR OutOfMemory", "a2", None), ("3", "PYTHON", 'Traceback (most recent call last)\n  File "x.py", line 3, in f\nKeyError: k', None, None),
        ("4", "DATAX", "jdbc:mysql://db:3306/x channel=3 mysqlreader hdfswriter", None, None), ("5", "SHELL", "x.sh: line 4: foo: command not found", None, None), ("6", "DEPENDENT", 'waiting timeout "definitionCode": 12, "cycle": "day"', None, None),
        ("7", "SUB_PROCESS", '"processDefinitionCode": 55', None, None), ("8", "TIMEOUT", None, None, "w1"), ("9", "FLINK", "fine", None, None),
    ]
    got = {r["alert_id"]: r for r in skills.analyse(spark.createDataFrame(rows, "alert_id string, task_type string, text string, app string, workflow string")).collect()}
    assert len(got) == 9
    assert (got["1"]["needs_deep"], got["1"]["blocks"]) == (True, ["ERROR FetchFailed x", "killed by YARN", "stage 1"])
    assert (got["2"]["needs_deep"], got["2"]["blocks"], got["2"]["error_type"]) == (False, ["ERROR OutOfMemory"], "oom_executor")
    assert got["3"]["facts"] == {"exception": "KeyError", "message": "k", "file": "x.py", "line": "3", "function": "f"} and got["3"]["error_type"] == "key_error"
    assert got["4"]["facts"] == {"database": "mysql", "host": "db:3306", "channels": "3", "reader": "mysqlreader", "writer": "hdfswriter"}
    assert got["5"]["facts"] == {"error": "command_not_found", "log_line": "1", "script_line": "4"}
    assert (got["6"]["error_type"], got["6"]["facts"]) == ("dependent_waiting_timeout", {"definitions": "12", "cycle": "day", "instance": "i9", "failed_tasks": "t1,t2"})
    assert (got["7"]["error_type"], got["7"]["facts"]) == ("sub_workflow_failed", {"definition": "55", "instance": "c5", "failed_tasks": "t7,t8"})
    assert got["8"]["error_type"] == "task_retry_timeout" and got["8"]["facts"]["confidence"] == "0.9"
    assert (got["9"]["task_type"], got["9"]["error_type"]) == ("SHELL", "UNKNOWN")
    fixes = spark.createDataFrame([("3", "use get")], "alert_id string, fix string")
    listed = {(r["alert_id"], r["ord"]): r["action"] for r in diagnosis.first_actions(skills.analyse(spark.createDataFrame(rows[:3], "alert_id string, task_type string, text string, app string, workflow string")), fixes).collect()}
    assert listed[("3", 0)] == "use get" and ("3", 1) in listed and ("1", 0) in listed and ("2", 0) not in listed


def test_sources_and_sinks_round_trip(spark, tmp_path):
    graph_doc = {"project_code": "p", "scanned_at": "t", "nodes": {"workflows": [{"code": "w"}], "tasks": [{"code": "t1", "workflow_code": "w"}], "tables": [{"full_name": "a.b"}], "classes": []}, "edges": {"workflow_contains_task": [{"workflow": "w", "task": "t1"}], "workflow_depends_workflow": [{"from": "w", "to": "v"}], "task_produces_table": [{"task": "t1", "table": "a.b"}]}}
    (tmp_path / "graphs").mkdir()
    (tmp_path / "graphs/p.json").write_text(json.dumps(graph_doc, indent=1))
    got = files.read_graphs(spark, str(tmp_path / "graphs"))
    assert {(r["edge_type"], r["source"], r["target"]) for r in got["edges"].collect()} == {("workflow_contains_task", "w", "t1"), ("workflow_depends_workflow", "w", "v"), ("task_produces_table", "t1", "a.b")}
    turned = files.read_graphs(spark, str(tmp_path / "graphs"), "reversed")["edges"].filter("edge_type = 'workflow_depends_workflow'").first()
    assert (turned["source"], turned["target"], [r["code"] for r in got["tasks"].collect()]) == ("v", "w", ["t1"])

    edges = lambda rows: spark.createDataFrame(rows, "project string, source string, target string")
    files.write_by_project(edges([("p", "a", "b"), ("q", "a", "b")]), str(tmp_path / "edges"))
    files.write_by_project(edges([("p", "c", "d")]), str(tmp_path / "edges"))
    assert {(r["project"], r["source"]) for r in spark.read.parquet(str(tmp_path / "edges")).collect()} == {("p", "c"), ("q", "a")}
    index = graph.reached_index(graph.closure(edges([("p", "a", "b"), ("p", "b", "c")])))
    files.write_index(index, str(tmp_path / "indexes"), "downstream")
    assert {r["source"]: r["n"] for r in files.read_index(spark, str(tmp_path / "indexes"), "downstream", "p").collect()} == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        files.write_index(index, str(tmp_path / "indexes"), "workflow_nodes")

    (tmp_path / "code/x").mkdir(parents=True)
    (tmp_path / "code/x/A.sql").write_text("SELECT 1\nFROM t")
    assert [(r["path"].endswith("x/A.sql"), r["content"]) for r in files.read_texts(spark, str(tmp_path / "code")).collect()] == [(True, "SELECT 1\nFROM t")]
    (tmp_path / "store/2024-01-02/w1/t1").mkdir(parents=True)
    (tmp_path / "store/2024-01-02/w1/t1/driver.log").write_text("one\ntwo")
    assert [tuple(r) for r in files.read_logs(spark, str(tmp_path / "store")).collect()] == [("2024-01-02", "w1", "t1", "driver", "one\ntwo")]
    logs_of = spark.createDataFrame([(f"2024-01-0{k}", "w", "t", "driver", "x" * k) for k in range(1, 5)] + [("2024-01-01", "w", "t", "yarn", "")], "dt string, workflow_code string, task_code string, source string, text string")
    files.write_logs(logs_of, str(tmp_path / "kept"))
    assert {r["dt"]: (r["sources"], r["n_chars"]) for r in files.log_metadata(logs_of).collect()} == {f"2024-01-0{k}": (["driver"], k) for k in range(1, 5)}
    assert files.drop_old(spark, str(tmp_path / "kept"), "2024-01-10", 7) == 2 and files.drop_old(spark, str(tmp_path / "kept"), "2024-01-10", 7) == 0
    assert {str(r["dt"]) for r in spark.read.json(str(tmp_path / "kept")).collect()} == {"2024-01-03", "2024-01-04"}

    (tmp_path / "log").mkdir()
    (tmp_path / "log/app-1.log").write_text('{"Event": "SparkListenerJobStart", "Job ID": 1}\nnoise\n{"broken')
    assert [(r["app"], r["Event"]) for r in files.event_log(spark, str(tmp_path / "log")).collect()] == [("app-1", "SparkListenerJobStart")]
    assert {(r["path"][-9:], r["length"]) for r in files.listing(spark, str(tmp_path / "log")).collect()} == {("app-1.log", 62)}

    (tmp_path / "known/spark").mkdir(parents=True)
    (tmp_path / "known/spark/confirmed.json").write_text(json.dumps([{"id": "k1", "error_type": "oom", "pattern": "OOM", "status": "confirmed"}]))
    (tmp_path / "known/spark/pending.json").write_text(json.dumps([{"id": "k2", "pattern": "x"}]))
    known = files.read_knowledge(spark, str(tmp_path / "known"))
    assert {r["id"]: (r["task_type"], r["status"]) for r in known.collect()} == {"k1": ("SPARK", "confirmed"), "k2": ("SPARK", "pending")}
    files.write_knowledge(known, str(tmp_path / "known2"))
    assert {(r["id"], r["task_type"], r["status"]) for r in spark.read.json(str(tmp_path / "known2")).collect()} == {("k1", "SPARK", "confirmed"), ("k2", "SPARK", "pending")}

    operations = spark.createDataFrame([("2024-01-01 10:00:00", "d" * 600, "ok")], "timestamp string, operation_detail string, result string")
    files.write_audit(operations, str(tmp_path / "audit"))
    r = spark.read.json(str(tmp_path / "audit")).first()
    assert (len(r["operation_detail"]), str(r["dt"])) == (500, "2024-01-01")
    rows = spark.createDataFrame([("1", "2024-01-01", "w", "l" * 600, "oom", "RESOURCE", 3, "medium", "HIGH", True), ("2", "2024-01-01", "v", "x", "e", "c", 0, "low", "LOW", False)], "alert_id string, dt string, workflow_code string, log_text string, error_type string, category string, n_downstream int, impact_level string, risk string, needs_approval boolean")
    files.write_reports(alerts.reports(rows), str(tmp_path / "reports"))
    stored = spark.read.json(str(tmp_path / "reports")).withColumn("dt", F.col("dt").cast("string"))
    first = alerts.list_reports(stored, "2024-01-01", "w").first()
    assert (first["alert_id"], len(first["log_preprocess"]["log_text"]), first["risk_assessment"]["n_downstream"], first["error_analysis"]["error_type"]) == ("1", 500, 3, "oom")
    assert alerts.reports(rows).columns == ["alert_id", "dt", "workflow_code", *alerts.SECTIONS]
    assert [r["alert_id"] for r in alerts.list_reports(stored, "2024-01-01", n=1).collect()] == ["1"]
    issues = spark.createDataFrame([("p", "c", "HIGH", "s", "d"), ("p", "c", "LOW", "r", "d")], "project string, category string, severity string, subject string, detail string")
    r = files.issue_report(issues).first()
    assert (r["n"], r["n_high"], r["n_low"], [x["subject"] for x in r["issues"]]) == (2, 1, 1, ["s", "r"])


def test_a_large_catalogue_gives_the_same_rules(spark):
    rules = spark.createDataFrame([("SPARK", "A", k % 3, k, f"e{k}", f"word{k}\\b", "h") for k in range(40)], "task_type string, category string, category_rank int, ord int, error_type string, pattern string, hint string")
    df = spark.createDataFrame([(str(k), "SPARK", f"x word{k} word{k + 3} y") for k in range(60)] + [("none", "SHELL", "word1"), ("null", "SPARK", None)], "log_id string, task_type string, text string")
    shown = lambda found: sorted(map(str, (tuple(r) for r in found.collect())))
    assert shown(match.match_rules(df, rules)) == shown(match.match_rules(df, rules, most_rules=1))
    known = rules.selectExpr("error_type AS id", "task_type", "concat('word', ord, ' ') AS pattern", "ord % 2 = 0 AS has_fix", "ord", "'confirmed' AS status")
    assert shown(match.match_knowledge(df, known)) == shown(match.match_knowledge(df, known, most_rules=1))


def test_snippets_fall_back_to_the_head(spark):
    df = logs.lines(spark.createDataFrame([("a", "\n".join(f"line {k}" for k in range(20))), ("b", "x" * 400 + "\n" + "y" * 400), ("c", "")], "log_id string, text string"))
    got = {r["log_id"]: (r["line_no"], r["snippet"]) for r in logs.snippets(df, "line 9$").collect()}
    assert got == {"a": (10, "\n".join(f"line {k}" for k in range(4, 15))), "b": (None, "x" * 400 + "\n" + "y" * 99), "c": (None, "")}


def test_sizes_by_data_match_plain_code(spark):
    gib, kinds = 1 << 30, [*runs.EXECUTOR_ERRORS, *runs.DRIVER_ERRORS, *runs.TIMEOUT_ERRORS, "oom_offheap", "oom_storage", "executor_lost_heartbeat", "else"]
    rnd = random.Random(3)
    rows = [(k, {"spark.executor.memory": "3g", "spark.driver.memory": "900m"} if rnd.random() < 0.6 else {}, *(rnd.choice([None, 0, rnd.randint(1, 40) * gib // 3]) for _ in range(4))) for k in kinds for _ in range(12)]

    def text_of(mb):
        return f"{mb // 1024}g" if mb >= 1024 and mb % 1024 == 0 else f"{mb}m"

    def plain(kind, config, *sizes):
        data, read, write, spilled = ((x or 0) / gib for x in sizes)
        executor, driver = (3072, 900) if config else (1024, 512)
        if kind in runs.EXECUTOR_ERRORS:
            mb = max(int((max(data * 0.6, executor / 1024) * (1.5 if spilled else 1) + read * 0.3) * 1024), int(executor * 1.5))
            return {"spark.executor.memory": text_of(mb), "spark.executor.memoryOverhead": text_of(max(mb // 4, 256))}
        if kind in runs.DRIVER_ERRORS:
            base = max(2, driver / 1024)
            mb = max(int((write * 0.2 + base if write > 1 else base) * 1024), int(driver * 1.5))
            return {"spark.driver.memory": text_of(mb), "spark.driver.maxResultSize": text_of(min(mb // 2, 2048))}
        if kind in runs.TIMEOUT_ERRORS:
            return {"spark.shuffle.io.timeout": "300s" if read > 10 else "120s", "spark.network.timeout": "600s" if read > 10 else "300s"}
        if kind == "oom_offheap":
            return {"spark.memory.offHeap.enabled": "true", "spark.memory.offHeap.size": text_of(int(max(2, read * 0.2) * 1024))}
        if kind == "oom_storage":
            return {"spark.memory.storageFraction": "0.3"}
        if kind == "executor_lost_heartbeat":
            return {"spark.executor.heartbeatInterval": "60s", "spark.network.timeout": "300s"}
        return {"spark.executor.memory": text_of(executor * 2), "spark.executor.memoryOverhead": text_of(executor // 2)}

    df = spark.createDataFrame(rows, "error_type string, config map<string, string>, input_bytes long, shuffle_read_bytes long, shuffle_write_bytes long, spilled_bytes long")
    for r in runs.data_driven_changes(df).collect():
        assert r["changes"] == plain(*list(r)[:-1]), r
