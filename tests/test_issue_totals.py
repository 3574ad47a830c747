"""Counts of issues without the edges by a rule, against the issues themselves."""

import pytest
from test_dense import made

from tracelake import plans
from tracelake.operators import dense, validation


def totals(df):
    return sorted(map(tuple, df.select("project", "category", "severity", "n").collect()))


@pytest.fixture
def unmade(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("edges by a rule were made")

    return lambda: monkeypatch.setattr(dense.Dense, "expanded", refuse)


@pytest.mark.parametrize("seed,loose", [(1, True), (2, True), (3, False)])
def test_totals_are_those_of_the_issues(spark, unmade, seed, loose):
    edges, _ = made(spark, seed, loose)
    sides = []
    for i, e in enumerate(edges):
        tasks = [("x", str(t), "w", "a" if t % (i + 2) else None, 0.0 if t % 2 else -0.0 * i) for t in range(9)]
        sides.append({
            "workflows": spark.createDataFrame([("x", "w", f"n{i}"), ("y", f"v{i}", "n")], "project string, code string, name string"),
            "tasks": spark.createDataFrame(tasks[i:], "project string, code string, workflow string, task_type string, main_class double"),
            "edges": e,
        })
    uses = spark.createDataFrame([("x", "t", "consume"), ("x", "t", "consume"), ("x", "ads.t", "consume"), ("y", "t", "produce"), ("y", None, "consume")], "project string, table_name string, role string")
    tables = uses.select("project", "table_name").filter("table_name IS NOT NULL").distinct()
    want = totals(validation.validate(*sides, tables, uses).groupBy("project", "category", "severity").count().withColumnRenamed("count", "n"))
    assert {c for _, c, _, _ in want} >= {"task_type", "no_producer", "workflow_extra"} | ({"dependency_extra", "dependency_missing"} if loose else set())
    assert "main_class" not in {c for _, c, _, _ in want}  # 0.0 and -0.0 are equal
    plain = [s | {"edges": s["edges"].edges()} for s in sides]
    assert totals(validation.issue_totals(*plain, tables, uses)) == want
    unmade()
    assert totals(validation.issue_totals(*sides, tables, uses)) == want
    assert totals(validation.issue_totals(*sides, None, uses)) == want


def test_the_query_makes_no_edges(spark, unmade):
    unmade()
    found = plans.QUERIES["validation_issues"](spark, "/root/testdata/sf0.001").filter("category = 'dependency_extra'").collect()
    assert found and all(r["n"] > 0 for r in found)
