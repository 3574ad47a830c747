"""Streams give what the batch form gives."""

import json
import os

import pytest

from tracelake.operators import graph, runs
from tracelake.operators import alerts as batch_alerts
from tracelake.streaming import alerts as streams

MESSAGES = ['{"projectCode": 1, "taskType": "sql"}', "hello", '[{"projectCode": 2}, {"taskType": "x"}]', '{"alerts": "[{\\"projectCode\\": 3}]"}', '{"taskInstanceId": 4}', '[{"taskType": 5}]']


def ran(stream, name, mode="append"):
    """The rows of a stream that reads all that there is."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return stream.sparkSession.table(name).collect()


def lines(spark, folder, rows, schema):
    """A stream of rows, a file for each list."""
    folder.mkdir(exist_ok=True)
    for k, part in enumerate(rows):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in part))
        os.utime(folder / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_alert_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(MESSAGES))
    raw = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "raw")
    got = ran(streams.alert_stream(raw).select("project_code", "task_instance_id", "task_type"), "seen_alerts")
    want = [("1", None, "SQL"), ("2", None, "SHELL"), (None, None, "SHELL"), ("3", None, "SHELL"), (None, "4", "SHELL")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def instances(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return events.selectExpr("CAST(event_id AS STRING) AS id", "CAST(user_id % 5 AS STRING) AS project", "CASE event_type WHEN 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS state", "event_type AS task_type", "concat('e', user_id % 3) AS error_type", "ts AS start_time", "value AS duration")


def test_daily_metrics_streams(spark, tmp_path):
    rows = instances(spark)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {(r["project"], r["day"]): (r["total"], r["failure"]) for r in ran(streams.daily_metrics(stream), "days", "update")}
    assert got == {(r["project"], r["day"]): (r["total"], r["failure"]) for r in runs.daily_workflow_metrics(rows).collect()}
    got = {(r["project"], r["day"], r["task_type"]): (r["total"], r["failure"], round(r["avg_duration"], 6)) for r in ran(streams.daily_type_metrics(stream), "types", "update")}
    assert got == {(r["project"], r["day"], r["task_type"]): (r["total"], r["failure"], round(r["avg_duration"], 6)) for r in runs.daily_type_metrics(rows).collect()}
    audit = stream.selectExpr("start_time AS timestamp", "state AS result", "project AS risk_level", "task_type AS operation_type")
    got = {(r["day"], r["result"], r["risk_level"], r["operation_type"]): r["n"] for r in ran(streams.audit_counts(audit), "audits", "update")}
    want = rows.groupBy("state", "project", "task_type", rows["start_time"].cast("date").alias("day")).count().collect()
    assert got == {(r["day"], r["state"], r["project"], r["task_type"]): r["count"] for r in want}


def test_deduplicated_stream(spark, tmp_path):
    row = lambda ts, log: {"ts": f"2024-01-01T{ts}:00Z", "skill_name": "s", "original_log": log}
    stream = lines(spark, tmp_path / "in", [[row("01:00", "a"), row("01:01", "b")], [row("01:02", "a"), row("01:03", "c")]], "ts timestamp, skill_name string, original_log string")
    assert sorted(r["original_log"] for r in ran(streams.deduplicated(stream), "firsts")) == ["a", "b", "c"]


def test_enriched_stream_gives_what_the_batch_gives(spark, tmp_path):
    row = lambda i, task_type, text: {"alert_id": str(i), "project": "p", "code": f"w{i}", "task_type": task_type, "text": text}
    schema = "alert_id string, project string, code string, task_type string, text string"
    rows = [[row(1, "SPARK", "x OutOfMemoryError"), row(2, "SHELL", "permission denied")], [row(3, "SPARK", "fine")]]
    stream = lines(spark, tmp_path / "in", rows, schema)
    rules = spark.createDataFrame([("SPARK", "AUTO_FIXABLE", 1, 1, "oom", "OutOfMemory", "more"), ("SPARK", "AUTO_FIXABLE", 1, 2, "late", "memory", "")], "task_type string, category string, category_rank int, ord int, error_type string, pattern string, hint string")
    known = spark.createDataFrame([("k1", "SHELL", "denied", True, 1, "confirmed")], "id string, task_type string, pattern string, has_fix boolean, ord int, status string")
    index = graph.reached_index(graph.closure(spark.createDataFrame([("p", "w1", "w2"), ("p", "w2", "w3")], "project string, source string, target string")))
    out = str(tmp_path / "out")
    q = streams.enrich_stream(stream, rules, known, index, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    shown = lambda df: sorted(str(r.asDict()) for r in df.drop("batch").collect())
    got = spark.read.parquet(out)
    assert shown(got) == shown(streams.enriched_alerts(spark.createDataFrame([tuple(r.values()) for part in rows for r in part], schema), rules, known, index))
    assert {r["alert_id"]: (r["error_type"], r["knowledge_id"], r["n_downstream"]) for r in got.collect()} == {"1": ("oom", None, 2), "2": ("UNKNOWN", "k1", 1), "3": ("UNKNOWN", None, 0)}


def test_stream_keeps_the_examples_of_the_batch(spark, tmp_path, rocks):
    """Over several micro-batches, the same three ids as in one sort."""
    rows = instances(spark).filter("state = 'FAILURE'").repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for r in ran(streams.daily_error_metrics(stream, late="400 days"), "errors", "update"):
        key = (r["project"], r["day"], r["error_type"])
        got[key] = max(got.get(key, (0,)), (r["n"], r["task_types"], r["examples"]))
    assert got == {(r["project"], r["day"], r["error_type"]): (r["n"], r["task_types"], r["examples"]) for r in runs.daily_error_metrics(rows).collect()}


def test_feedback_takes_the_last_execution(spark, tmp_path, rocks):
    at = lambda m: f"2024-01-01T01:{m:02d}:00Z"
    f = [{"user": "u", "ts": at(5), "feedback_id": "f1"}, {"user": "v", "ts": at(6), "feedback_id": "f2"}, {"user": "u", "ts": at(30), "feedback_id": "f3"}]
    e = [{"user": "u", "ts": at(1), "execution_id": "a"}, {"user": "u", "ts": at(4), "execution_id": "b"}, {"user": "u", "ts": at(7), "execution_id": "c"}, {"user": "v", "ts": at(0), "execution_id": "d"}]
    later = "2024-01-02T00:00:00Z"
    feedbacks = lines(spark, tmp_path / "f", [f, [{"user": "w", "ts": later, "feedback_id": "end"}], [{"user": "w", "ts": later, "feedback_id": "end2"}]], "user string, ts timestamp, feedback_id string")
    executions = lines(spark, tmp_path / "e", [e, [{"user": "w", "ts": later, "execution_id": "end"}], [{"user": "w", "ts": later, "execution_id": "end2"}]], "user string, ts timestamp, execution_id string")
    got = {r["feedback_id"]: r["execution_id"] for r in ran(streams.feedback_pairs(feedbacks, executions), "pairs")}
    assert {k: v for k, v in got.items() if k.startswith("f")} == {"f1": "b", "f2": None, "f3": None}
    batch = batch_alerts.feedback_matches(spark.createDataFrame([(r["user"], r["ts"], r["feedback_id"]) for r in f], "user string, ts string, feedback_id string").selectExpr("user", "CAST(ts AS timestamp) AS ts", "feedback_id"), spark.createDataFrame([(r["user"], r["ts"], r["execution_id"]) for r in e], "user string, ts string, execution_id string").selectExpr("user", "CAST(ts AS timestamp) AS ts", "execution_id"))
    assert {r["feedback_id"]: r["execution_id"] for r in batch.collect()} == {"f1": "b", "f2": None, "f3": None}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_approvals_count_by_their_own_time(spark, tmp_path, rocks):
    far, gone = 4_000_000_000_000, 1_000
    row = lambda i, kind, status=None, ts=0, expires=0: {"request_id": i, "kind": kind, "status": status, "ts_ms": ts, "expires_ms": expires}
    first = [row("a", "request", expires=far), row("b", "request", expires=gone), row("c", "decision", "approved", 500), row("d", "request", expires=far), row("e", "request", expires=gone)]
    second = [row("a", "decision", "approved", 10), row("b", "decision", "rejected", 900), row("c", "request", expires=gone), row("e", "decision", "approved", 2_000), row("a", "decision", "rejected", 20)]
    stream = lines(spark, tmp_path / "in", [first, second], "request_id string, kind string, status string, ts_ms long, expires_ms long")
    last = {}
    for r in ran(streams.approvals(stream), "approvals", "update"):
        last.setdefault(r["request_id"], []).append(r["status"])
    assert last["a"] == ["pending", "approved"] and last["d"] == ["pending"]
    assert last["b"][0] == "pending" and last["b"][-1] == "rejected"
    assert last["c"] == ["pending", "approved"] and last["e"][-1] == "timeout"
