"""Edges by a rule against the same edges made one by one."""

import random

import pytest

from tracelake.operators import dense, graph, lineage, validation


def made(spark, seed, loose=True):
    """Two sides that follow one rule, and the edges of each."""
    r = random.Random(seed)
    nodes = [(p, str(i), i % 3) for p in "xy" for i in range(r.choice((1, 12)))]
    targets = spark.createDataFrame([(p, n, (b * 2) % 3) for p, n, b in nodes], "project string, target string, block int")
    sides, edges = [], []
    for _ in range(2):
        own = [n for n in nodes if r.random() < 0.6]
        more = {(p, r.choice("012345z"), r.choice("012345z")) for p in "xyz" for _ in range(9)} if loose else set()
        sources = spark.createDataFrame(own, "project string, source string, block int")
        extra = spark.createDataFrame(sorted(more), "project string, source string, target string") if loose else None
        sides.append(dense.Dense(sources, targets, extra))
        edges.append({(p, a, b) for p, a, i in own for q, b, j in nodes if p == q and i == (j * 2) % 3 and a != b} | more)
    return sides, edges


def rows(df):
    out = [tuple(r) for r in df.select(dense.EDGE).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("seed,loose", [(1, True), (2, True), (3, False)])
def test_edges_by_a_rule(spark, monkeypatch, seed, loose):
    monkeypatch.setattr(dense, "PER_LIST", 2)
    monkeypatch.setattr(dense, "PER_TASK", 5)
    (a, b), (ea, eb) = made(spark, seed, loose)
    frame = lambda e: spark.createDataFrame(sorted(e), "project string, source string, target string")
    assert rows(a.edges()) == ea
    assert rows(a.among(frame(eb | {("x", "0", "0"), ("q", "1", "2")}))) == ea & (eb | {("x", "0", "0"), ("q", "1", "2")})
    assert rows(dense.minus(a, b)) == ea - eb and rows(dense.minus(b, a)) == eb - ea
    on = ["source", "target"]
    table = lambda df: sorted(map(tuple, df.collect()))
    assert table(validation.match_rates(a, b, on)) == table(validation.match_rates(frame(ea), frame(eb), on))
    assert table(validation.set_differences(a, b, on, "d")) == table(validation.set_differences(frame(ea), frame(eb), on, "d"))
    assert table(graph.merged_edges(k=frame(eb), r=a)) == table(graph.merged_edges(k=frame(eb), r=frame(ea)))
    pairs = frame(ea | eb | {("x", "0", "0"), ("q", "1", "2")})
    told = a.flagged(pairs, "source", "target", "is_edge").collect()
    assert len(told) == pairs.count() and {tuple(r)[:3] for r in told if r["is_edge"]} == ea and {r["is_edge"] for r in told} <= {True, False}
    roles = spark.createDataFrame([("x", "1", "main"), ("y", "2", "test"), ("w", "3", "child")], "project string, code string, role string")
    assert table(lineage.role_counts(roles, e=a)) == table(lineage.role_counts(roles, e=frame(ea)))
    uses = spark.createDataFrame([(p, str(w), t, role) for p in "xy" for w in range(6) for t, role in ((f"t{w % 4}", "produce"), (f"t{w % 3}", "consume"))], "project string, workflow string, table_name string, role string")
    assert table(lineage.implicit_dependencies(uses, a)) == table(lineage.implicit_dependencies(uses, frame(ea)))
