"""Traversals of random graphs, with cycles, against plain ones."""

import random

import pytest

from tracelake.operators import graph

EDGE = "project string, source string, target string"


def graphs():
    """By project, random edges: sparse, dense, a chain, a ring with tails, two rings in a row, loops, and none."""
    rng = random.Random(3)
    out = {}
    for k, (nodes, n) in enumerate(((12, 14), (7, 18), (25, 40))):
        out[f"r{k}"] = {(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(n)}
    out["chain"] = {(f"c{i:02}", f"c{i + 1:02}") for i in range(9)}
    out["ring"] = {(f"c{i:02}", f"c{(i + 1) % 7:02}") for i in range(7)} | {("a", "c03"), ("c05", "z"), ("z", "zz")}
    out["rings"] = {(f"{p}{i}", f"{p}{(i + 1) % 3}") for p in "ab" for i in range(3)} | {("a2", "b1"), ("loop", "loop")}
    return out


def distances(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for start in {a for a, _ in edges}:
        seen, at, depth = {start}, {start}, 0
        while at:
            depth += 1
            at = {b for a in at for b in after.get(a, ())} - seen
            seen |= at
            out |= {(start, b): depth for b in at}
    return out


def frame(spark, by_project):
    return spark.createDataFrame([(p, *e) for p, es in by_project.items() for e in es], EDGE)


@pytest.fixture(scope="module")
def data(spark):
    return graphs(), frame(spark, graphs())


def test_closure_has_least_depths(data):
    by_project, edges = data
    want = {(p, *k): d for p, es in by_project.items() for k, d in distances(es).items()}
    assert {(r.project, r.source, r.target): r.depth for r in graph.closure(edges).collect()} == want
    near = {k: d for k, d in want.items() if d <= 5}
    assert {(r.project, r.source, r.target): r.depth for r in graph.closure(edges, max_depth=5).collect()} == near


def test_components_are_mutual_reach_and_stand_for_the_closure(data):
    by_project, edges = data
    want, pairs = {}, set()
    for p, es in by_project.items():
        far = distances(es)
        for x in {n for e in es for n in e}:
            want[p, x] = min([x, *(b for (a, b) in far if a == x and (b, a) in far)])
        pairs |= {(p, *k) for k in far}
    members, between = graph.condensed_closure(edges)
    assert {(r.project, r.code): r.component for r in members.collect()} == want
    assert len({(p, c) for (p, _), c in want.items()}) < len(want)
    assert {(r.project, r.source, r.target) for r in graph.expanded(members, between).collect()} == pairs


def simple_paths(edges, start, most):
    todo, out = [[start]], []
    while todo:
        path = todo.pop()
        for a, b in edges:
            if a == path[-1] and b not in path and len(path) <= most:
                todo.append([*path, b])
                out.append([*path, b])
    return out


def test_cycles_and_paths_are_those_of_a_search(data):
    by_project, edges = data
    want = set()
    for p, es in by_project.items():
        for start in {a for a, _ in es}:
            for path in [[start], *simple_paths(es, start, 7)]:
                if (path[-1], start) in es and min(path) == start and len(path) <= 8:
                    want.add((p, *path))
    assert {(r.project, *r.cycle) for r in graph.cycles(edges, 8).collect()} == want
    some = by_project["r1"]
    source, target = "n0", max(b for (a, b) in distances(some) if a == "n0")
    found = sorted(tuple(r.path) for r in graph.all_paths(edges, "r1", source, target, 6).collect())
    assert found == sorted(tuple(x) for x in simple_paths(some, source, 6) if x[-1] == target and len(x) <= 7)
    assert found


def test_small_parts_take_no_round_a_step(spark, monkeypatch):
    """A ring of 60 and a chain of 60: rounds would be as many as they are long."""
    calls, real = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: calls.append(1) or real(df))
    edges = {(f"n{i:02}", f"n{(i + 1) % 60:02}") for i in range(60)} | {(f"c{i:02}", f"c{i + 1:02}") for i in range(59)}
    found = graph.cycles(frame(spark, {"p": edges}), 60).collect()
    assert [list(r.cycle) for r in found] == [[f"n{i:02}" for i in range(60)]]
    assert len(calls) < 20
    assert graph.cycles(frame(spark, {"p": edges}), 59).count() == 0


@pytest.mark.parametrize("edges,cycle,more", [(0, 0, 0), (9, 256, 19), (4096, 12, 19), (4096, 256, 1)])
def test_parts_by_rounds_and_by_tasks_are_the_same(data, monkeypatch, edges, cycle, more):
    want = sorted(map(tuple, graph.cycles(data[1], 6).collect())), sorted(map(tuple, graph.strong_components(data[1]).collect()))
    for name, value in (("MOST_EDGES", edges), ("CYCLE_EDGES", cycle), ("CYCLE_MORE", more)):
        monkeypatch.setattr(graph, name, value)
    assert (sorted(map(tuple, graph.cycles(data[1], 6).collect())), sorted(map(tuple, graph.strong_components(data[1]).collect()))) == want


def test_no_path_is_followed_that_cannot_end(spark, data, monkeypatch):
    """From the tail of the ring nothing leads back to a: the first frontier is empty."""
    seen = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: seen.append(real(df)) or seen[-1])
    assert graph.all_paths(data[1], "ring", "c02", "a", 12).count() == 0
    assert all(x.isEmpty() for x in seen if "path" in x.columns) and sum("path" in x.columns for x in seen) == 1


@pytest.mark.parametrize("seed", range(3))
def test_an_edited_closure_is_one_made_anew(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    before = {"p": {(rng.choice(nodes), rng.choice(nodes)) for _ in range(16 + 6 * seed)}, "q": {("a", "b"), ("b", "c")}}
    removed = {"p": set(rng.sample(sorted(before["p"]), rng.choice([0, 1, 3])))}
    added = {"p": {(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.choice([0, 1, 4]))} if seed else set()}
    after = {"p": (before["p"] - removed["p"]) | added["p"], "q": before["q"]}
    old = graph.closure(frame(spark, before))
    rows, sources = graph.edited_closure(old, frame(spark, before), frame(spark, added), frame(spark, removed))
    kept = old.join(sources, ["project", "source"], "left_anti").unionByName(rows)
    got = sorted((r.project, r.source, r.target, r.depth) for r in kept.collect())
    assert got == sorted((p, *k, d) for p, es in after.items() for k, d in distances(es).items())
    assert all(r.project == "p" for r in sources.collect())
