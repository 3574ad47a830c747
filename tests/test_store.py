"""Journals and keyed tables: retries, failures half-way, history, and what a change touches."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import alerts, graph, review
from tracelake.sources import files
from tracelake.sources.store import ConcurrentChange, Folder, Journal, KeyedTable


def test_a_batch_is_stored_once_whatever_fails(spark, tmp_path, monkeypatch):
    journal = Journal(spark, str(tmp_path / "j"))
    rows = spark.createDataFrame([(1, "2024-01-01", "a"), (2, "2024-01-02", "b")], "id int, dt string, text string")
    real = Folder.create
    monkeypatch.setattr(Folder, "create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):  # the files are there, the log isn't
        journal.append(rows, "job-1", ("dt",))
    monkeypatch.setattr(Folder, "create", real)
    with pytest.raises(ValueError, match="nothing"):
        journal.read()
    assert journal.append(rows, "job-1", ("dt",)) and not journal.append(rows, "job-1", ("dt",))
    assert journal.append(rows.withColumn("id", F.col("id") + 10), "job-2", ("dt",))
    assert sorted(r.id for r in journal.read().collect()) == [1, 2, 11, 12]
    assert [r.text for r in journal.read(["job-2"]).filter("dt = '2024-01-02'").collect()] == ["b"]
    with pytest.raises(ValueError, match="named"):
        journal.append(rows, "../x")


def test_sinks_take_a_batch_once(spark, tmp_path):
    logs = spark.createDataFrame([("2024-01-01", "w/1", "t 1", "s", "text"), ("2024-01-01", "w", "t", "s", "")], "dt string, workflow_code string, task_code string, source string, text string")
    audit = spark.createDataFrame([("2024-01-01 10:00:00", "x" * 900)], "timestamp string, operation_detail string")
    report = alerts.reports(spark.createDataFrame([("a1", "2024-01-01", "w")], "alert_id string, dt string, workflow_code string"))
    for _ in range(2):
        files.write_logs(logs, str(tmp_path / "logs"), "run-7")
        files.write_audit(audit, str(tmp_path / "audit"), "run-7")
        files.write_reports(report, str(tmp_path / "reports"), "run-7")
    read = lambda x: Journal(spark, str(tmp_path / x)).read().collect()
    assert [(r.workflow_code, r.task_code) for r in read("logs")] == [("w_1", "t_1")]
    assert [len(r.operation_detail) for r in read("audit")] == [500]
    assert [(r.alert_id, r.workflow_code) for r in read("reports")] == [("a1", "w")]


@pytest.fixture
def decisions(spark):
    schema = "candidate_id string, status string, reviewed_by string, reviewed_at string, note string"
    return lambda *rows: spark.createDataFrame([(c, s, "x", at, None) for c, s, at in rows], schema)


def test_decisions_merge_by_their_own_time(spark, tmp_path, decisions):
    stored = KeyedTable(spark, str(tmp_path / "k"), ("candidate_id",), buckets=8)
    first = decisions(*((f"c{k}", "pending", "1") for k in range(40)))
    assert review.merge_decisions(stored, first, "b0") == 0
    assert review.merge_decisions(stored, decisions(("c1", "approved", "5"), ("c1", "rejected", "3"), ("new", "approved", "2")), "b1") == 1
    assert review.merge_decisions(stored, decisions(("c1", "rejected", "4")), "b2") == 2  # made before, read later
    assert review.merge_decisions(stored, decisions(("c1", "rejected", "9")), "b1") is None
    now = {r.candidate_id: r.status for r in stored.read().collect()}
    assert now == {f"c{k}": "pending" for k in range(40)} | {"c1": "approved", "new": "approved"}
    assert {r.status for r in stored.read(0).collect()} == {"pending"} and stored.versions() == [0, 1, 2]


def test_other_buckets_keep_their_files(spark, tmp_path, decisions):
    stored = KeyedTable(spark, str(tmp_path / "k"), ("candidate_id",), buckets=16)
    review.merge_decisions(stored, decisions(*((f"c{k}", "pending", "1") for k in range(100))), "b0")
    before = stored._log(None)["buckets"]
    review.merge_decisions(stored, decisions(("c1", "approved", "5")), "b1")
    after = stored._log(None)["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)


def test_of_two_changes_at_once_one_is_told(spark, tmp_path, decisions, monkeypatch):
    stored = KeyedTable(spark, str(tmp_path / "k"), ("candidate_id",), buckets=2)
    review.merge_decisions(stored, decisions(("c1", "pending", "1")), "b0")
    old = stored._log(None)
    review.merge_decisions(stored, decisions(("c2", "pending", "1")), "b1")
    monkeypatch.setattr(stored, "_log", lambda version: old)
    with pytest.raises(ConcurrentChange):
        review.merge_decisions(stored, decisions(("c3", "pending", "1")), "b2")
    monkeypatch.undo()
    assert sorted(r.candidate_id for r in stored.read().collect()) == ["c1", "c2"]


def test_a_stored_closure_follows_its_edges(spark, tmp_path):
    rng = random.Random(2)
    frame = lambda es: spark.createDataFrame([("p", *e) for e in sorted(es)], "project string, source string, target string")
    edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)} | {("far", "away")}
    index = files.closure_index(spark, str(tmp_path / "c"), buckets=32)
    files.build_closure(index, frame(edges), "b0")
    old = index._log(None)["buckets"]
    gone, come = set(rng.sample(sorted(edges - {("far", "away")}), 2)), {("n1", "n7"), ("new", "n2")}
    files.edit_closure(index, frame(edges), frame(come), frame(gone), "b1")
    want = sorted(map(tuple, graph.closure(frame((edges - gone) | come)).collect()))
    assert sorted(tuple(r[c] for c in ("project", "source", "target", "depth")) for r in index.read().collect()) == want
    assert len(index.read(0).collect()) == len(graph.closure(frame(edges)).collect())
    assert sum(old[b] == index._log(None)["buckets"].get(b) for b in old) > 0


def test_feedback_takes_the_last_execution_within_the_range(spark):
    rng = random.Random(4)
    stamp = lambda t: f"2024-01-01 {t // 3600:02}:{t // 60 % 60:02}:{t % 60:02}"
    done = [(u, t, f"{t:05}") for u in ("a", "hot", None) for t in sorted(rng.sample(range(9000), 40 if u != "hot" else 900))]
    asked = [(u, rng.randrange(9000), k) for k, u in enumerate(["a", "hot", "nobody"] * 60)] + [("hot", done[50][1], 999)]
    f = spark.createDataFrame([(u, stamp(t), k) for u, t, k in asked], "user string, ts string, feedback_id int").withColumn("ts", F.col("ts").cast("timestamp"))
    e = spark.createDataFrame([(u, stamp(t), x) for u, t, x in done], "user string, ts string, execution_id string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {k: max((x for v, s, x in done if v == u and t - 60 <= s <= t), default=None) for u, t, k in asked}
    assert {r.feedback_id: r.execution_id for r in alerts.feedback_matches(f, e, 60).collect()} == want
    assert None in want.values() and len(set(want.values())) > 30
