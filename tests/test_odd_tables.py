"""Registered queries against their SQL on the smallest tables with one of them changed."""

import random
import re
import shutil
from pathlib import Path

import duckdb
import pyarrow as pa

from tracelake import plans
from tracelake.operators import graph, lineage, logs, segments

from test_queries import SF, TABLES, shown


def differences(spark, folder, name, **changed):
    """Rows of a query and of its SQL that the other lacks; changed gives tables as SQL over the given ones."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if t in changed:
            con.execute(f"COPY ({changed[t].format(t=f"'{SF}/{t}.parquet'")}) TO '{path}' (FORMAT parquet)")
        else:
            shutil.copy(Path(SF) / f"{t}.parquet", path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    df = plans.QUERIES[name](spark, str(folder))
    got = sorted(tuple(shown(v) for v in r) for r in df.collect())
    found = con.execute(plans.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    want = sorted(tuple(shown(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    assert want
    return [r for r in got if r not in want], [r for r in want if r not in got]


def test_workflows_without_tasks(spark, tmp_path):
    assert differences(spark, tmp_path, "workflow_nodes", orders="SELECT * FROM {t} WHERE o_custkey % 10 <> 3") == ([], [])


def test_waits_halfway_between_two_numbers(spark, tmp_path):
    assert differences(spark, tmp_path, "timeout_metrics", events="SELECT * REPLACE (event_id % 4 + 0.5::DOUBLE AS value) FROM {t}") == ([], [])


def test_table_checks_join_their_uses_without_the_tasks_again(spark):
    for name, most in (("table_checks", 7), ("accuracy_checks", 13)):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("Relation [") <= most


def test_ends_of_orders_that_come_twice(spark, tmp_path):
    twice = "SELECT * FROM {t} UNION ALL SELECT * REPLACE (nullif(o_custkey + 1, 7) AS o_custkey) FROM {t} WHERE o_orderkey % 4 = 0"
    assert differences(spark, tmp_path, "implicit_dependencies", orders=twice) == ([], [])


def test_pairs_are_made_once_and_from_their_ends(spark):
    for name, most in (("implicit_dependencies", 8), ("missing_dependencies", 8), ("independent_dependencies", 20), ("role_counts", 12)):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        print(name, plan.count("Relation ["))
        assert 0 < plan.count("Relation [") <= most


def test_number_of_what_is_downstream_is_counted_without_making_pairs_distinct_again(spark):
    plan = plans.QUERIES["impact"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan and "partial_count(target" in plan


def test_edit_of_a_long_chain_takes_rounds_that_double(spark, monkeypatch):
    chain = [("p", k, k + 1) for k in range(40)]
    edges = spark.createDataFrame(chain, "project string, source long, target long").repartition(2)
    gone, come = edges.filter("source = 38"), spark.createDataFrame([("p", 39, 50)], edges.schema)
    found = graph.checkpointed(graph.closure(edges))
    made, before = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (made.append(1), before(df))[1])
    rows, sources = graph.edited_closure(found, edges, come, gone)
    got = {tuple(r) for r in rows.select("source", "target", "depth").collect()}
    assert {r.source for r in sources.collect()} == set(range(40))
    assert got == {(a, b, b - a) for a in range(38) for b in range(a + 1, 39)} | {(39, 40, 1), (39, 50, 1)}
    assert len(made) < 25


def test_blocks_of_many_short_logs_come_together():
    cell = pa.struct([("line_no", pa.int64()), ("kind", pa.int32()), ("line", pa.string())])
    cells = pa.array([[], *([{"line_no": 1, "kind": segments.START, "line": f"e{k}"}, {"line_no": 2, "kind": segments.OTHER, "line": None}] for k in range(5000))], pa.list_(cell))
    n = len(cells)
    whole = pa.RecordBatch.from_arrays([pa.array(range(-1, n - 1)), cells, pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64())], names=["log_id", "cells", "state", "block"])
    got = list(segments._replay(30)([whole.slice(0, 7), whole.slice(7)]))
    assert [(r["log_id"], r["pos"], r["line_no"], r["line"]) for b in got for r in b.to_pylist()] == [(k, 1, 1, f"e{k}") for k in range(5000)]
    assert len(got) <= 3


def test_lines_are_tested_for_starts_as_by_each_pattern():
    whole = logs._any(logs.STARTS, "(?i)")
    assert whole.count(r"\b(?:") == 1 and whole.startswith("(?i)^(?:")
    texts = ("an error here", "terror", "xprocess has exited, exitStatusCode = 3", "exitStatusCode: 0", "java.io.IOException", "see java.io.X", "run /bin/bash: error", "FooError: x", "a FooError: x", "ORA-1", "grep: x", "my grep: x", "Path a does not exist", "table x doesnt exist", "")
    for text in texts:
        assert bool(re.search(whole, text)) == any(re.search(p, text, re.I) for p in logs.STARTS), text


def test_tasks_after_a_task_in_small_and_large_workflows(spark, monkeypatch):
    rng = random.Random(5)
    edges = {(f"w{w}", f"{w}.{rng.randrange(n)}", f"{w}.{rng.randrange(n)}") for w, n in enumerate((3, 9, 20, 30)) for _ in range(n + 3)}
    want = {}
    for w, a, _ in edges:
        seen, at = set(), {a}
        while at:
            at = {c for v, b, c in edges if b in at} - seen
            seen |= at
        if seen - {a}:
            want[w, a] = len(seen - {a})
    frame = spark.createDataFrame([("p", a, b) for _, a, b in edges], "project string, source string, target string")
    tasks = spark.createDataFrame(sorted({("p", x, w) for w, a, b in edges for x in (a, b)}), "project string, code string, workflow string")
    calls = spark.createDataFrame([], frame.schema)
    index = spark.createDataFrame([], "project string, source string, n long")
    # Rounds over pairs aren't made for small workflows.
    monkeypatch.setattr(graph, "closure", None)
    for most in (4096, 10):
        monkeypatch.setattr(graph, "MOST_EDGES", most)
        rows = graph.sub_workflow_impact(frame, tasks, calls, index).collect()
        assert {(r.workflow, r.task): r.n for r in rows if r.scope == "sub"} == {(r.workflow, r.task): r.n for r in rows if r.scope == "total"} == want
        assert len(rows) == 2 * len(want)
        monkeypatch.undo()


def test_an_extraction_that_is_given_twice_is_made_once_and_reads_each_file_once(spark):
    plan = plans.QUERIES["merged_uses"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 3 and plan.count("Relation [") == 7


def test_tables_that_a_file_names_twice(spark):
    text = '"""INSERT INTO aa SELECT 1 FROM bb""" """INSERT INTO aa SELECT 2 FROM bb JOIN aa"""'
    found = lineage.class_uses(spark.createDataFrame([("p", "c", "t", "/c.java"), ("p", "d", "t", "/no.java")], "project string, class string, task string, path string"), spark.createDataFrame([("/c.java", text), ("/c.java", text), ("/no.java", None)], "path string, content string"))
    assert sorted((r.table_name, r.role) for r in found.collect()) == [("aa", "consume"), ("aa", "produce"), ("bb", "consume")]
