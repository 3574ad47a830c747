"""Merged edges in lists, and what lists leave out."""

import io
from contextlib import redirect_stdout

import pytest
from test_dense import made, rows

from tracelake.operators import dense, graph


@pytest.mark.parametrize("seed,per_list", [(1, 3), (2, 1024)])
def test_lists_hold_the_merged_edges(spark, monkeypatch, seed, per_list):
    monkeypatch.setattr(dense, "PER_LIST", per_list)
    (a, _), (ea, eb) = made(spark, seed)
    other = spark.createDataFrame(sorted(eb), "project string, source string, target string")
    lists = graph.merged_lists(k=other, r=a).collect()
    got = sorted((r["project"], r["source"], t, *r["edge_types"]) for r in lists for t in r["targets"])
    assert got == sorted((*e, *(k for k, x in (("k", eb), ("r", ea)) if e in x)) for e in ea | eb)
    alone = graph.merged_lists(r=a).collect()
    assert sorted((r["project"], r["source"], t) for r in alone for t in r["targets"]) == sorted(ea)


def test_nothing_is_looked_at_edge_by_edge(spark):
    rule = made(spark, 1, loose=False)[0][0]
    with redirect_stdout(io.StringIO()) as out:
        rule.expanded().explain()
    assert "NOT (source" not in out.getvalue()


def test_codes_that_are_null_or_of_other_types(spark):
    sources = spark.createDataFrame([("x", 1, 0), ("x", 2, 0), ("x", None, 0)], "project string, source int, block int")
    targets = spark.createDataFrame([("x", 1, 0), ("x", 3, 0), ("x", None, 0), ("y", 1, 0)], "project string, target int, block int")
    without = spark.createDataFrame([("x", 2, 3), ("x", 2, 9)], "project string, source long, target long")
    rule = dense.Dense(sources, targets)
    assert rows(rule.expanded()) == {("x", 1, 3), ("x", 2, 1), ("x", 2, 3)}
    assert sorted(sorted(r["targets"]) for r in rule.listed().collect()) == [[1, 3], [3]]
    assert rows(rule.expanded(without)) == {("x", 1, 3), ("x", 2, 1)}
