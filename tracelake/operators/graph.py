"""Traversals of edge tables (project, source, target), for all projects and starts at once.

Loops run over rounds, not rows: each extends all frontiers by one join, and is written to the checkpoint folder, so that
plans stay short and an executor's loss costs a round at most. Only the number of new rows comes to the driver.
"""

import tempfile
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tracelake

from .dense import EDGE, Dense

#: Functions travel to executors with their code, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(tracelake)

#: The most edges of a workflow, or of a connected part of a graph, that are looked at in one task.
MOST_EDGES = 4096
#: One task finds the cycles of a component with so many edges, and so many more edges than nodes, at most. With k more
#: there are fewer than 2 ** (k + 1) cycles.
CYCLE_EDGES, CYCLE_MORE = 256, 19


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the folder that spark.checkpoint.dir names. A local session may do without the setting."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def clean(edges: DataFrame) -> DataFrame:
    return edges.select("project", "source", "target").filter("source IS NOT NULL AND target IS NOT NULL").distinct()


def closure(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(project, source, target, depth): everything that can be reached from each source, at its least depth.

    The start isn't its own target, even on a cycle. seeds (project, source) restricts the starts, whose frontiers then move
    on by an edge a round; without it the result holds all pairs, which is large by nature, and each round doubles the depth:
    what is farther than d, up to 2d, is reached over a node at just d.
    """
    steps = checkpointed(clean(edges).filter("source != target"))
    if seeds is None:
        return _all_pairs(steps.withColumn("depth", F.lit(1)), 1, max_depth)
    first = steps.join(seeds.select("project", "source").distinct(), ["project", "source"], "left_semi")
    frontier = checkpointed(first.withColumn("depth", F.lit(1)))
    rounds, hop = [frontier], steps.select("project", F.col("source").alias("target"), F.col("target").alias("next"))
    depth = 1
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        reached = frontier.join(hop, ["project", "target"]).filter("next != source").select("project", "source", F.col("next").alias("target")).distinct()
        known = reduce(DataFrame.unionByName, rounds).select("project", "source", "target")
        frontier = checkpointed(reached.join(known, ["project", "source", "target"], "left_anti").withColumn("depth", F.lit(depth)))
        rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds)


def _all_pairs(found: DataFrame, depth: int, max_depth: int | None = None, others: DataFrame | None = None) -> DataFrame:
    """The closure from the pairs up to depth; others are all pairs of other sources, if these are known. Nodes lead the keys:
    rows are sorted by the first column at first, and a project is the same for many."""
    rounds, last, key = [found], found, ["source", "target", "project"]
    while max_depth is None or depth < max_depth:
        known = reduce(DataFrame.unionByName, rounds)
        far = last.filter(F.col("depth") == depth).select("project", "source", "target")
        hop = known if others is None else known.unionByName(others.filter(F.col("depth") <= depth))
        hop = hop.select("project", F.col("source").alias("target"), F.col("target").alias("next"), F.col("depth").alias("more"))
        longer = far.join(hop, ["target", "project"]).filter("next != source").select("project", "source", F.col("next").alias("target"), (F.col("more") + depth).alias("depth"))
        if max_depth is not None:
            longer = longer.filter(F.col("depth") <= max_depth)
        longer = longer.groupBy(key).agg(F.min("depth").alias("depth"))
        last = checkpointed(longer.join(known.select(key), key, "left_anti").select("project", "source", "target", "depth"))
        depth *= 2
        if last.isEmpty():
            break
        rounds.append(last)
    return reduce(DataFrame.unionByName, rounds)


def weak_components(edges: DataFrame) -> DataFrame:
    """(project, code, root) of every node that has an edge to another one: the smallest node that it is connected with,
    whichever way edges lead. By alternating large-star and small-star joins, whose rounds grow with the logarithm of the
    longest chain."""
    at = edges.filter("source != target AND project IS NOT NULL").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v"), "project")
    at, before = checkpointed(at.distinct()), None
    while (state := at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v", "project"))).first()) != before:
        before = state
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v"), "project"))
        least = both.groupBy("u", "project").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "project")
        large = at.join(least, ["v", "project"]).select("u", F.col("m").alias("v"), "project").distinct()
        lowest = large.groupBy("u", "project").agg(F.min("v").alias("m"))
        moved = large.join(lowest, ["u", "project"]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"), "project")
        at = checkpointed(lowest.select("u", F.col("m").alias("v"), "project").unionByName(moved).distinct())
    roots = at.select("project", F.col("v").alias("code"), F.col("v").alias("root")).distinct()
    return at.select("project", F.col("u").alias("code"), F.col("v").alias("root")).unionByName(roots)


def _by_part(edges: DataFrame, part: str, found, schema: str) -> DataFrame:
    """The rows that found(edges of a part) gives for each part of edges (project, part, source, target), with the project
    before them. A task reads its parts in order and keeps the edges of one at a time."""

    def search(batches):
        types, out = None, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def read():
            nonlocal types
            for batch in batches:
                project, code = batch.schema.field("project").type, batch.schema.field("source").type
                types = [project, *(pa.list_(code) if x == "cycle" else code for x in names[1:])]
                yield from zip(*(batch[c].to_pylist() for c in ("project", part, "source", "target")))

        for (project, _), rows in groupby(read(), key=lambda r: r[:2]):
            for row in found([r[2:] for r in rows]):
                out.append((project, *row))
                if len(out) == 8192:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    names = [x.split()[0] for x in schema.split(", ")]
    rows = edges.select("project", part, "source", "target").repartition(part, "project").sortWithinPartitions(part, "project")
    return rows.mapInArrow(search, schema)


def strong_components(edges: DataFrame) -> DataFrame:
    """(project, code, component) of every node that has an edge: the smallest node of its strongly connected component.

    Connected parts of up to MOST_EDGES edges are each looked at in one task; only larger ones are left to rounds.
    """
    all_edges = checkpointed(clean(edges))
    roots = weak_components(all_edges).withColumnRenamed("code", "source")
    parts = checkpointed(all_edges.filter("source != target").join(roots, ["source", "project"]))
    large = checkpointed(parts.groupBy("root", "project").agg(F.count("*").alias("_n")).filter(F.col("_n") > MOST_EDGES).select("root", "project"))
    none = large.isEmpty()
    project, code = (all_edges.schema[c].dataType.simpleString() for c in ("project", "source"))
    small = parts if none else parts.join(large, ["root", "project"], "left_anti")
    members = _by_part(small, "root", components_of, f"project {project}, code {code}, component {code}")
    if not none:
        members = members.unionByName(_components_by_rounds(parts.join(large, ["root", "project"], "left_semi").select("project", "source", "target")))
    nodes = all_edges.select("project", F.explode(F.array("source", "target")).alias("code")).distinct()
    return nodes.join(members, ["code", "project"], "left").select("project", "code", F.coalesce("component", "code").alias("component"))


def components_of(edges: list[tuple]) -> list[tuple]:
    """(node, component) of those nodes that are in a component of two nodes or more. A node is done once all after it are;
    of those that are open, the ones from the first that it leads back to are a component then."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    number, low, open_, inside, out = {}, {}, [], set(), []
    for start in after:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        open_.append(start)
        inside.add(start)
        stack = [(start, iter(after[start]))]
        while stack:
            node, left = stack[-1]
            for b in left:
                if b not in number:
                    number[b] = low[b] = len(number)
                    open_.append(b)
                    inside.add(b)
                    stack.append((b, iter(after.get(b, ()))))
                    break
                if b in inside:
                    low[node] = min(low[node], number[b])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == number[node]:
                    found = [open_.pop()]
                    while found[-1] != node:
                        found.append(open_.pop())
                    inside.difference_update(found)
                    if len(found) > 1:
                        least = min(found)
                        out += [(x, least) for x in found]
    return out


def _components_by_rounds(edges: DataFrame) -> DataFrame:
    """(project, code, component) of those nodes that are in a component of two nodes or more.

    Nodes that nothing leads to, or that lead nowhere, are components of their own and are peeled off first, layer by layer.
    In what is left every node takes the greatest node that reaches it as its colour; the nodes that reach the one that gave
    the colour are its component. Edges between colours go, and the rest is done again.
    """
    left, done = _peeled(edges), []
    while not left.isEmpty():
        nodes = left.select("project", F.explode(F.array("source", "target")).alias("code")).distinct()
        colours = checkpointed(nodes.select("project", "code", F.col("code").alias("colour"), F.lit(True).alias("moved")))
        while not colours.filter("moved").isEmpty():
            sent = colours.filter("moved").select("project", F.col("code").alias("source"), "colour").join(left, ["project", "source"])
            sent = sent.groupBy("project", F.col("target").alias("code")).agg(F.max("colour").alias("new"))
            better = F.coalesce(F.col("new") > F.col("colour"), F.lit(False))
            colours = colours.join(sent, ["project", "code"], "left").select("project", "code", F.when(better, F.col("new")).otherwise(F.col("colour")).alias("colour"), better.alias("moved"))
            colours = checkpointed(colours)
        colours = colours.drop("moved")
        inside = left
        for end in ("source", "target"):
            inside = inside.join(colours.select("project", F.col("code").alias(end), F.col("colour").alias(f"_{end}")), ["project", end])
        inside = checkpointed(inside.filter("_source = _target").select("project", "source", "target", F.col("_source").alias("colour")))
        back = checkpointed(colours.filter("code = colour"))
        found = [back]
        while not back.isEmpty():
            before = inside.join(back.select("project", F.col("code").alias("target"), "colour"), ["project", "target", "colour"])
            before = before.select("project", F.col("source").alias("code"), "colour").distinct()
            back = checkpointed(before.join(reduce(DataFrame.unionByName, found), ["project", "code"], "left_anti"))
            found.append(back)
        members = reduce(DataFrame.unionByName, found)
        done.append(members)
        for end in ("source", "target"):
            inside = inside.join(members.select("project", F.col("code").alias(end)), ["project", end], "left_anti")
        left = _peeled(inside.drop("colour"))
    if not done:
        return edges.select("project", F.col("source").alias("code"), F.col("source").alias("component")).limit(0)
    members = checkpointed(reduce(DataFrame.unionByName, done))
    named = members.groupBy("project", "colour").agg(F.min("code").alias("component"))
    return members.join(named, ["project", "colour"]).select("project", "code", "component")


def _peeled(edges: DataFrame) -> DataFrame:
    """edges without those that can't be on a cycle because nothing leads to them, or they lead nowhere."""
    left, before = checkpointed(edges), -1
    while (n := left.count()) not in (before, 0):  # a layer from both ends in each round
        before = n
        ins, outs = left.select("project", F.col("target").alias("source")), left.select("project", F.col("source").alias("target"))
        left = checkpointed(left.join(ins.distinct(), ["project", "source"], "left_semi").join(outs.distinct(), ["project", "target"], "left_semi"))
    return left


def condensed_closure(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): strong_components(edges), and the pairs (project, source, target) of components of which one
    reaches the other. A component stands for all its nodes, so that a large cycle isn't expanded into all its pairs."""
    members = checkpointed(strong_components(edges))
    ends = clean(edges)
    for end in ("source", "target"):
        named = members.select("project", F.col("code").alias(end), F.col("component").alias(f"_{end}"))
        ends = ends.join(named, ["project", end])
    between = ends.select("project", F.col("_source").alias("source"), F.col("_target").alias("target")).filter("source != target")
    return members, closure(between).select("project", "source", "target")


def expanded(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(project, source, target): the closure that members and pairs of condensed_closure() stand for."""
    size = members.groupBy("project", "component").count().filter("count > 1").select("project", F.col("component").alias("source"), F.col("component").alias("target"))
    one = members.select("project", F.col("component").alias("source"), F.col("code").alias("_source"))
    other = members.select("project", F.col("component").alias("target"), F.col("code").alias("_target"))
    out = pairs.unionByName(size).join(one, ["project", "source"]).join(other, ["project", "target"])
    return out.filter("_source != _target").select("project", F.col("_source").alias("source"), F.col("_target").alias("target"))


def edited_closure(found: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): what replaces a stored closure when a few edges change.

    found is the closure of edges (project, source, target, depth), removed and added are edges that go and come. sources
    (project, source) are those whose rows are to be replaced by rows; all others keep theirs. A removed edge counts for
    the sources on one of whose shortest paths it lies; what they reach is derived again from the edges that stay and from the
    rows of the other sources, in rounds that double the depth. An added
    edge leads from all that reach its start to all that its end reaches, over other added edges too.
    """
    key = ["project", "source", "target"]
    new, old = (checkpointed(clean(x).filter("source != target")) for x in (added, removed))
    now = clean(edges).join(old, key, "left_anti")
    # Sources with a shortest path over a removed edge: it ends one deeper than it starts.
    start = found.select("project", F.col("source").alias("s"), F.col("target").alias("source"), F.col("depth").alias("_a"))
    own = old.select("project", F.col("source").alias("s"), "source", F.lit(0).alias("_a")).distinct()
    end = found.select("project", F.col("source").alias("s"), "target", F.col("depth").alias("_b"))
    reach = start.unionByName(own).join(old, ["project", "source"])
    hit = checkpointed(reach.join(end, ["project", "s", "target"]).filter("_b = _a + 1").select("project", F.col("s").alias("source")).distinct())
    others = checkpointed(found.select(*key, "depth").join(hit, ["project", "source"], "left_anti").select(*key, "depth"))
    first = checkpointed(now.filter("source != target").join(hit, ["project", "source"], "left_semi").select(*key, F.lit(1).alias("depth")))
    again = _all_pairs(first, 1, others=others)
    if new.isEmpty():
        return again, hit
    kept = others.unionByName(again)
    # Distances between the ends of added edges: over the edges, and from an end to a start by what is known.
    ends = new.select("project", F.col("target").alias("source")).distinct()
    starts = new.select("project", F.col("source").alias("target")).distinct()
    known = kept.join(ends, ["project", "source"], "left_semi").join(starts, ["project", "target"], "left_semi")
    same = ends.join(starts, (ends.project == starts.project) & (ends.source == starts.target)).select(ends.project, "source", "target", F.lit(0).alias("depth"))
    hub = checkpointed(new.withColumn("depth", F.lit(1)))
    between = checkpointed(known.unionByName(same).select("project", F.col("source").alias("target"), F.col("target").alias("_start"), F.col("depth").alias("_gap")))
    step = hub.select("project", F.col("source").alias("_start"), F.col("target").alias("_end"), F.col("depth").alias("_edge"))
    while True:
        longer = hub.join(between, ["project", "target"]).join(step, ["project", "_start"])
        longer = longer.select("project", "source", F.col("_end").alias("target"), (F.col("depth") + F.col("_gap") + F.col("_edge")).alias("depth"))
        better = checkpointed(hub.unionByName(longer).groupBy(*key).agg(F.min("depth").alias("depth")))
        if better.join(hub, [*key, "depth"], "left_anti").isEmpty():
            break
        hub = better
    into = kept.select("project", "source", F.col("target").alias("_from"), F.col("depth").alias("_a")).join(hub.select("project", F.col("source").alias("_from")).distinct(), ["project", "_from"], "left_semi")
    into = into.unionByName(hub.select("project", "source", F.col("source").alias("_from"), F.lit(0).alias("_a")).distinct())
    out = kept.select("project", F.col("source").alias("_to"), "target", F.col("depth").alias("_b")).join(hub.select("project", F.col("target").alias("_to")).distinct(), ["project", "_to"], "left_semi")
    out = out.unionByName(hub.select("project", F.col("target").alias("_to"), "target", F.lit(0).alias("_b")).distinct())
    middle = hub.select("project", F.col("source").alias("_from"), F.col("target").alias("_to"), "depth")
    through = into.join(middle, ["project", "_from"]).join(out, ["project", "_to"]).filter("source != target")
    through = through.groupBy(*key).agg(F.min(F.col("_a") + F.col("depth") + F.col("_b")).alias("_new"))
    shorter = through.join(kept, key, "left").filter("depth IS NULL OR _new < depth").select(*key, F.col("_new").cast("int").alias("depth"))
    shorter = checkpointed(shorter)
    sources = checkpointed(hit.unionByName(shorter.select("project", "source")).distinct())
    rows = kept.join(sources, ["project", "source"], "left_semi").join(shorter, key, "left_anti").unionByName(shorter)
    return rows, sources


def reached_index(all_pairs: DataFrame) -> DataFrame:
    """Direct and all downstream codes of each source, and their number; all_pairs has each pair once, as closure() gives them."""
    return all_pairs.groupBy("project", "source").agg(
        F.array_sort(F.collect_set(F.when(F.col("depth") == 1, F.col("target")))).alias("direct"),
        F.array_sort(F.collect_set("target")).alias("all"),
        F.count("target").alias("n")
    )


def downstream(edges: DataFrame, project: str, code: str) -> DataFrame:
    seed = edges.sparkSession.createDataFrame([(project, code)], "project string, source string")
    return closure(edges, seed)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        "project",
        F.col("target").alias("source"),
        F.col("source").alias("target"),
        *(c for c in edges.columns if c not in ("project", "source", "target"))
    )


def upstream(edges: DataFrame, project: str, code: str) -> DataFrame:
    """Everything that code can be reached from: the closure over reversed edges, the right way round."""
    return reversed_edges(downstream(reversed_edges(edges), project, code))


def within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members (project, code)."""
    m = members.select("project", "code").distinct()
    out = edges
    for c in ("source", "target"):
        out = out.join(m.withColumnRenamed("code", c), ["project", c], "left_semi")
    return out


def reachable_again(relations: DataFrame, project: str, task: str) -> DataFrame:
    """Downstream of a task from raw relations; the start is among it if a cycle leads back."""
    found = downstream(relations, project, task)
    back = found.select("project", F.col("target").alias("s")).unionByName(found.select("project", F.col("source").alias("s"))).distinct()
    loop = relations.filter(F.col("target") == task).join(back.withColumnRenamed("s", "source"), ["project", "source"], "left_semi")
    own = loop.select("project", F.lit(task).alias("source"), F.lit(task).alias("target"), F.lit(None).cast("int").alias("depth")).limit(1)
    return found.unionByName(own)


def paths(edges: DataFrame, seeds: DataFrame, max_depth: int, simple: bool = True) -> DataFrame:
    """(project, path): simple paths from the seeds (project, source), of at most max_depth edges."""
    hop = checkpointed(clean(edges).select("project", F.col("source").alias("last"), F.col("target").alias("next")))
    at = seeds.select("project", F.array("source").alias("path"))
    out = None
    for _ in range(max_depth):
        at = at.withColumn("last", F.element_at("path", -1)).join(hop, ["project", "last"]).filter(~F.array_contains("path", F.col("next")))
        at = checkpointed(at.select("project", F.array_append("path", F.col("next")).alias("path")))
        out = at if out is None else out.unionByName(at)
        if at.isEmpty():
            break
    return out


def all_paths(edges: DataFrame, project: str, source: str, target: str, max_depth: int) -> DataFrame:
    """Simple paths of at most max_depth edges; their number is exponential in it, so the caller gives it.

    How far each node is from the target is found first; a path is followed only as far as it can still end there in time.
    """
    ours = clean(edges).filter((F.col("project") == project) & (F.col("source") != target))
    spark = edges.sparkSession
    end = spark.createDataFrame([(project, target)], "project string, source string")
    away = closure(reversed_edges(ours), end, max_depth).select("project", F.col("target").alias("next"), F.col("depth").alias("_left"))
    away = away.unionByName(end.select("project", F.col("source").alias("next"), F.lit(0).alias("_left")))
    hop = checkpointed(ours.select("project", F.col("source").alias("last"), F.col("target").alias("next")).join(away, ["project", "next"]))
    at = spark.createDataFrame([(project, [source])], "project string, path array<string>")
    out = at.limit(0)
    for depth in range(1, max_depth + 1):
        step = at.withColumn("last", F.element_at("path", -1)).join(hop, ["project", "last"])
        step = step.filter((F.col("_left") <= max_depth - depth) & ~F.array_contains("path", F.col("next")))
        at = checkpointed(step.select("project", F.array_append("path", F.col("next")).alias("path")))
        if at.isEmpty():
            break
        out = out.unionByName(at.filter(F.element_at("path", -1) == target))
    return out


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(project, source, target, path): a shortest path to everything that a seed reaches; of equals the smallest."""
    hop = checkpointed(clean(edges).select("project", F.col("source").alias("target"), F.col("target").alias("next")))
    frontier = checkpointed(seeds.select("project", "source", F.col("source").alias("target"), F.array("source").alias("path")))
    rounds, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(hop, ["project", "target"]).select(
            "project",
            "source",
            F.col("next").alias("target"),
            F.array_append("path", F.col("next")).alias("path")
        )
        step = step.groupBy("project", "source", "target").agg(F.min("path").alias("path"))
        known = reduce(DataFrame.unionByName, rounds).select("project", "source", "target")
        frontier = checkpointed(step.join(known, ["project", "source", "target"], "left_anti"))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds).filter("source != target")


def cycles(edges: DataFrame, max_depth: int) -> DataFrame:
    """(project, cycle): each simple cycle of at most max_depth edges once, from its smallest node; loops included.

    Only edges within strongly connected components are followed, and a path only as far as it can come back in time. A
    component with few edges (CYCLE_EDGES, CYCLE_MORE) is looked at in one task; others are followed in rounds.
    """
    steps = checkpointed(clean(edges))
    loops = steps.filter("source = target").select("project", F.array("source").alias("cycle"))
    members = checkpointed(strong_components(steps))
    inside = steps.filter("source != target")
    for end in ("source", "target"):
        inside = inside.join(members.select("project", F.col("code").alias(end), F.col("component").alias(f"_{end}")), [end, "project"])
    inside = checkpointed(inside.filter("_source = _target").select("project", "source", "target", F.col("_source").alias("component")))
    key = ["component", "project"]
    # Every node of a component leads on, so that its nodes are its sources.
    out = inside.groupBy("source", *key).agg(F.count("*").alias("_n")).groupBy(key).agg(F.sum("_n").alias("_n"), F.count("*").alias("_nodes"))
    large = checkpointed(out.filter((F.col("_n") > CYCLE_EDGES) | (F.col("_n") - F.col("_nodes") > CYCLE_MORE)).select(key))
    none = large.isEmpty()
    project, code = (steps.schema[c].dataType.simpleString() for c in ("project", "source"))
    small = inside if none else inside.join(large, key, "left_anti")
    out = loops.unionByName(_by_part(small, "component", lambda part: cycles_of(part, max_depth), f"project {project}, cycle array<{code}>"))
    if none:
        return out
    return out.unionByName(_cycles_by_rounds(inside.join(large, key, "left_semi").select("project", "source", "target"), max_depth))


def cycles_of(edges: list[tuple], max_depth: int):
    """Each simple cycle of at most max_depth of edges without loops, as a list from its smallest node."""
    after, before = {}, {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    for first in after:
        # How far it is back to the first node, over greater ones.
        left, at, depth = {first: 0}, [first], 0
        while at and depth < max_depth:
            depth, far = depth + 1, at
            at = []
            for b in far:
                for a in before.get(b, ()):
                    if a > first and a not in left:
                        left[a] = depth
                        at.append(a)
        path, stack = [first], [iter(after[first])]
        while stack:
            for b in stack[-1]:
                if b == first:
                    if len(path) <= max_depth:
                        yield (list(path),)
                elif b in left and b not in path and len(path) + left[b] <= max_depth:
                    path.append(b)
                    stack.append(iter(after.get(b, ())))
                    break
            else:
                stack.pop()
                path.pop()


def _cycles_by_rounds(inside: DataFrame, max_depth: int) -> DataFrame:
    """The cycles of edges within components, all paths together by an edge a round."""
    inside = checkpointed(inside)
    # How far it is back to a path's first node.
    back = checkpointed(closure(inside, max_depth=max_depth).select("project", F.col("source").alias("next"), F.col("target").alias("first"), F.col("depth").alias("_left")))
    hop = inside.select("project", F.col("source").alias("last"), F.col("target").alias("next"))
    at = hop.filter("next > last").select("project", F.array("last", "next").alias("path"))
    out = None
    for depth in range(2, max_depth + 1):
        step = at.select("project", "path", F.element_at("path", -1).alias("last"), F.col("path")[0].alias("first")).join(hop, ["project", "last"])
        found = step.filter("next = first").select("project", F.col("path").alias("cycle"))
        out = found if out is None else out.unionByName(found)
        open_ = step.filter((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next")))
        open_ = open_.join(back, ["project", "next", "first"]).filter(F.col("_left") <= max_depth - depth)
        at = checkpointed(open_.select("project", F.array_append("path", F.col("next")).alias("path")))
        if at.isEmpty():
            break
    return at.select("project", F.col("path").alias("cycle")).limit(0) if out is None else out


def downstream_in_workflow(edges: DataFrame, tasks: DataFrame, project: str, task: str) -> DataFrame:
    """Downstream of a task among the tasks (project, code, workflow) of its own workflow."""
    own = tasks.filter((F.col("project") == project) & (F.col("code") == task)).select("project", "workflow")
    return downstream(within(edges, tasks.join(own, ["project", "workflow"], "left_semi")), project, task)


def path_edges(found: DataFrame) -> DataFrame:
    """The distinct edges of paths (project, path)."""
    steps = F.transform(F.slice("path", 1, F.size("path") - 1), lambda x, i: F.struct(x.alias("source"), F.get("path", i + 1).alias("target")))
    return found.select("project", F.explode(steps).alias("e")).select("project", "e.source", "e.target").distinct()


def table_edges(uses: DataFrame) -> DataFrame:
    """Lineage through tables as edges: task to table where it produces, table to task where it consumes."""
    makes = F.col("role") == "produce"
    return uses.select(
        "project",
        F.when(makes, F.col("task")).otherwise(F.col("table_name")).alias("source"),
        F.when(makes, F.col("table_name")).otherwise(F.col("task")).alias("target"),
        F.when(makes, "task_produces_table").otherwise("task_consumes_table").alias("edge_type")
    ).distinct()


def merged_edges(**kinds: DataFrame | Dense) -> DataFrame:
    """Edges of several kinds in one table, each edge once, with the sorted kinds that it is of.

    Of one kind by a rule, the edges that are of no other kind are neither shuffled nor grouped.
    """
    return unlisted(merged_lists(**kinds))


def unlisted(lists: DataFrame) -> DataFrame:
    """(project, source, target, edge_types) of merged_lists()."""
    return lists.select("project", "source", F.explode("targets").alias("target"), "edge_types")


def merged_lists(**kinds: DataFrame | Dense) -> DataFrame:
    """(project, source, targets, edge_types): merged_edges() with targets of equal kinds in lists. What is done to the kinds
    of a list isn't done edge by edge."""
    ruled = next((k for k, e in kinds.items() if isinstance(e, Dense)), None)
    rule = kinds.get(ruled)
    tables = {k: e.edges() if isinstance(e, Dense) else e for k, e in kinds.items() if k != ruled}
    if rule is None:
        return _single(_merged(tables))
    kind, extra = F.array(F.lit(ruled)).alias("edge_types"), rule.extra()
    if not tables:
        return rule.listed().select("*", kind).unionByName(_single(extra.select("*", kind)))
    others = reduce(DataFrame.unionByName, [e.select(EDGE) for e in tables.values()]).unionByName(extra)
    return rule.listed(others).select("*", kind).unionByName(_single(_merged(tables | {ruled: rule.among(others)})))


def _single(edges: DataFrame) -> DataFrame:
    return edges.select("project", "source", F.array("target").alias("targets"), "edge_types")


def _merged(kinds: dict[str, DataFrame]) -> DataFrame:
    parts = [e.select("project", "source", "target", F.lit(k).alias("edge_type")) for k, e in kinds.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("project", "source", "target").agg(
        F.array_sort(F.collect_set("edge_type")).alias("edge_types")
    )


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In and out degree of every node (project, code); 0 where it has no edges."""
    e = clean(edges)
    out = e.groupBy("project", F.col("source").alias("code")).agg(F.count("*").alias("out_degree"))
    into = e.groupBy("project", F.col("target").alias("code")).agg(F.count("*").alias("in_degree"))
    all_nodes = nodes.select("project", "code").distinct()
    return all_nodes.join(into, ["project", "code"], "left").join(out, ["project", "code"], "left").fillna(0, ["in_degree", "out_degree"])


def induced(edges: DataFrame, project: str, code: str) -> DataFrame:
    """Edges among a node and everything downstream of it."""
    found = downstream(edges, project, code)
    members = found.select("project", F.col("target").alias("code")).unionByName(found.select("project", F.col("source").alias("code")))
    return within(clean(edges), members)


def impact_level(n) -> F.col:
    return F.when(n == 0, "low").when(n <= 5, "medium").otherwise("high")


def impact(actions: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (project, code) with the number of what is downstream, its level, and where the number comes from."""
    n = index.select("project", F.col("source").alias("code"), F.col("n").alias("n_downstream"))
    out = actions.join(n, ["project", "code"], "left")
    out = out.withColumn("impact_source", F.when(F.col("n_downstream").isNotNull(), "graph").otherwise("none")).fillna(0, ["n_downstream"])
    return out.withColumn("impact_level", impact_level(F.col("n_downstream")))


def parent_impact(edges: DataFrame, calls: DataFrame, index: DataFrame) -> DataFrame:
    """(project, code, parent, in_parent, beyond): for each called workflow what follows it in its parent, and after that.

    edges are the dependencies between workflows, calls the parent -> sub-workflow edges, index that of reached_index().
    """
    direct = clean(edges).groupBy("project", F.col("source").alias("code")).agg(F.array_sort(F.collect_set("target")).alias("in_parent"))
    beyond = index.select("project", F.col("source").alias("parent"), F.col("all").alias("beyond"))
    out = calls.select("project", F.col("source").alias("parent"), F.col("target").alias("code")).distinct()
    empty = F.array().cast("array<string>")
    out = out.join(direct, ["project", "code"], "left").join(beyond, ["project", "parent"], "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("in_parent", "beyond")})


def _reached_counts(inner: DataFrame) -> DataFrame:
    """(project, workflow, task, n): how many tasks follow a task, by edges within workflows. A task counts what it finds in
    each of the workflows with up to MOST_EDGES edges; of larger ones the pairs are found by joins."""
    key = ["project", "workflow"]
    inner = checkpointed(inner)
    large = checkpointed(inner.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > MOST_EDGES).select(key))
    schema = f"project {inner.schema['project'].dataType.simpleString()}, workflow {inner.schema['workflow'].dataType.simpleString()}, task {inner.schema['source'].dataType.simpleString()}, n long"
    small = inner if large.isEmpty() else inner.join(large, key, "left_anti")
    ends = small.groupBy(key).agg(F.collect_list("source").alias("sources"), F.collect_list("target").alias("targets"))
    counted = ends.mapInArrow(_counts, schema)
    if large.isEmpty():
        return counted
    rest = inner.join(large, key, "left_semi").select(F.struct(key).alias("project"), "source", "target")
    rest = closure(rest).groupBy("source", "project").agg(F.count("target").alias("n"))
    return counted.unionByName(rest.select("project.project", "project.workflow", F.col("source").alias("task"), "n"))


def _counts(batches):
    for batch in batches:
        rows, tasks, numbers = [], [], []
        for row, (sources, targets) in enumerate(zip(batch["sources"].to_pylist(), batch["targets"].to_pylist())):
            for task, n in reached_numbers(sources, targets):
                rows.append(row)
                tasks.append(task)
                numbers.append(n)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["project"].take(at), batch["workflow"].take(at), pa.array(tasks, batch.schema.field("sources").type.value_type), pa.array(numbers, pa.int64())],
            names=["project", "workflow", "task", "n"],
        )


def reached_numbers(sources: list, targets: list) -> list[tuple]:
    """Of each source, how many others the edges lead to. Sets are bits of a number; nodes come after those they lead to, so
    that without cycles one pass finds all."""
    after: dict = {}
    for a, b in zip(sources, targets):
        after.setdefault(a, []).append(b)
    bit, order = {}, []
    for start in after:
        stack = [(start, iter(after[start]))] if start not in bit else []
        bit.setdefault(start, 1 << len(bit))
        while stack:
            node, left = stack[-1]
            for b in left:
                if b not in bit:
                    bit[b] = 1 << len(bit)
                    if b in after:
                        stack.append((b, iter(after[b])))
                        break
            else:
                order.append(node)
                stack.pop()
    reach, moved = dict.fromkeys(after, 0), True
    while moved:
        moved = False
        for node in order:
            found = 0
            for b in after[node]:
                found |= bit[b] | reach.get(b, 0)
            if found != reach[node]:
                reach[node], moved = found, True
    return [(node, n) for node, found in reach.items() if (n := (found & ~bit[node]).bit_count())]


def sub_workflow_impact(task_edges: DataFrame, tasks: DataFrame, calls: DataFrame, index: DataFrame) -> DataFrame:
    """(project, workflow, task, scope, n): tasks that follow a task in its own sub-workflow, and workflows after the
    parent; scopes are sub, parent and total."""
    owner = tasks.select("project", F.col("code").alias("source"), "workflow")
    other = tasks.select("project", F.col("code").alias("target"), F.col("workflow").alias("to_workflow"))
    inner = clean(task_edges).filter("source != target").join(owner, ["project", "source"]).join(other, ["project", "target"]).filter("workflow = to_workflow")
    within_sub = checkpointed(_reached_counts(inner.select("project", "workflow", "source", "target")))
    sub = within_sub.select("project", "workflow", "task", F.lit("sub").alias("scope"), "n")
    after = calls.select("project", F.col("source").alias("parent"), F.col("target").alias("workflow")).join(
        index.select("project", F.col("source").alias("parent"), "n"),
        ["project", "parent"]
    )
    parent = tasks.select("project", "workflow", F.col("code").alias("task")).join(after, ["project", "workflow"]).select(
        "project",
        "workflow",
        "task",
        F.lit("parent").alias("scope"),
        "n"
    )
    both = sub.unionByName(parent)
    return both.unionByName(both.groupBy("project", "workflow", "task").agg(F.sum("n").alias("n")).withColumn("scope", F.lit("total")))


def impact_with_fallback(alerts: DataFrame, by_sub: DataFrame, by_graph: DataFrame, by_relations: DataFrame) -> DataFrame:
    """alerts (alert_id) with the first number that is known of what is downstream: sub-workflow, graph, relations."""
    out, n, source = alerts, F.lit(None).cast("long"), F
    for name, table in (("sub_workflow", by_sub), ("graph", by_graph), ("relations", by_relations)):
        out = out.join(table.select("alert_id", F.col("n").alias(f"_{name}")), "alert_id", "left")
        n, source = F.coalesce(n, F.col(f"_{name}")), source.when(F.col(f"_{name}").isNotNull(), name)
    out = out.select(*alerts.columns, F.coalesce(n, F.lit(0)).alias("n_downstream"), source.otherwise("none").alias("impact_source"))
    return out.withColumn("impact_level", impact_level(F.col("n_downstream")))
