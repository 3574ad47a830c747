"""Reconciling two snapshots of a project (graph and scheduler), and checks of one."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dense import Dense, common_counts, minus, minus_counts
from .lineage import names_any

ISSUE = ("project", "category", "severity", "subject", "detail")


def _issues(df: DataFrame, category: str, severity: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(
        "project",
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        subject.alias("subject"),
        detail.cast("string").alias("detail")
    )


def set_differences(a: DataFrame | Dense, b: DataFrame | Dense, keys: list[str], category: str) -> DataFrame:
    """What only b has is missing (HIGH), what only a has is extra (MEDIUM). Edges by a rule are so on both sides."""
    subject = F.concat_ws("->", *keys)
    on = ["project", *keys]
    if isinstance(a, Dense):
        missing, extra = minus(b, a), minus(a, b)
    else:
        missing = b.select(on).distinct().join(a.select(on), on, "left_anti")
        extra = a.select(on).distinct().join(b.select(on), on, "left_anti")
    return _issues(missing, f"{category}_missing", "HIGH", subject, F.lit("")).unionByName(
        _issues(extra, f"{category}_extra", "MEDIUM", subject, F.lit(""))
    )


def attribute_differences(a: DataFrame, b: DataFrame, key: str, attribute: str, category: str) -> DataFrame:
    return several_differences(a, b, key, {attribute: category})


def several_differences(a: DataFrame, b: DataFrame, key: str, categories: dict[str, str]) -> DataFrame:
    """attribute_differences() of each attribute, with its category; the sides are joined once."""
    one, other = ([F.col(c).alias(f"_{x}_{c}") for c in categories] for x in "ab")
    both = a.select("project", key, *one).join(b.select("project", key, *other), ["project", key])
    told = []
    for c, category in categories.items():
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        detail = F.concat_ws(" / ", F.coalesce(x, F.lit("null")), F.coalesce(y, F.lit("null")))
        told.append(F.when(~x.eqNullSafe(y), F.struct(F.lit(category).alias("category"), detail.alias("detail"))))
    found = both.select("project", F.col(key).alias("subject"), F.explode(F.array(*told)).alias("_issue")).filter("_issue IS NOT NULL")
    return found.select("project", "_issue.category", F.lit("MEDIUM").alias("severity"), "subject", "_issue.detail")


def count_differences(a: DataFrame, b: DataFrame, key: str, category: str) -> DataFrame:
    ca, cb = (x.groupBy("project", key).agg(F.count("*").alias(n)) for x, n in ((a, "_a"), (b, "_b")))
    both = ca.join(cb, ["project", key], "full").fillna(0, ["_a", "_b"])
    return _issues(both.filter("_a != _b"), category, "MEDIUM", F.col(key), F.concat_ws(" / ", "_a", "_b"))


def set_valued_differences(a: DataFrame, b: DataFrame, key: str, member: str, category: str) -> DataFrame:
    sa, sb = (x.groupBy("project", key).agg(F.array_sort(F.collect_set(member)).alias(n)) for x, n in ((a, "_a"), (b, "_b")))
    both = sa.join(sb, ["project", key], "full")
    return _issues(
        both.filter(~F.col("_a").eqNullSafe(F.col("_b"))),
        category,
        "MEDIUM",
        F.col(key),
        F.concat_ws(" / ", F.coalesce(F.size("_a"), F.lit(0)), F.coalesce(F.size("_b"), F.lit(0)))
    )


def table_roles(tables: DataFrame | None, uses: DataFrame) -> DataFrame:
    """tables (project, table_name) with whether anything makes or reads them; without tables, those of the uses."""
    flags = uses.groupBy("project", "table_name").agg(
        F.max(F.col("role") == "produce").alias("produced"),
        F.max(F.col("role") == "consume").alias("consumed")
    )
    found = flags if tables is None else tables.join(flags, ["project", "table_name"], "left")
    return found.fillna(False, ["produced", "consumed"])


def table_checks(tables: DataFrame | None, uses: DataFrame, output_tokens: tuple[str, ...] = ("ads", "dws", "report")) -> DataFrame:
    """Tables that nothing uses, and tables that are read but not made, unless they are of an output layer."""
    name, unmade = F.col("table_name"), ~F.col("produced")
    rule = F.when(unmade & ~F.col("consumed"), "orphan_table").when(unmade & ~names_any(name, output_tokens), "no_producer")
    broken = table_roles(tables, uses).withColumn("category", rule).filter("category IS NOT NULL")
    return broken.select("project", "category", F.lit("MEDIUM").alias("severity"), name.alias("subject"), F.lit("").alias("detail"))


def accuracy_checks(workflows: DataFrame, tasks: DataFrame, tables: DataFrame, uses: DataFrame) -> DataFrame:
    """Tasks without a workflow, workflows without tasks, and of each table the first rule that it breaks."""
    w = workflows.select("project", F.col("code").alias("workflow"))
    lost = tasks.select("project", "code", "workflow").join(w, ["project", "workflow"], "left_anti")
    empty = w.join(tasks.select("project", "workflow"), ["project", "workflow"], "left_anti")
    name, made, read = F.col("table_name"), F.col("produced"), F.col("consumed")
    rule = (
        F.when(~made & ~read, "orphan_table")
        .when(names_any(name, ("ads", "dws", "report", "result", "output")) & ~made, "output_without_producer")
        .when(names_any(name, ("ods", "dwd", "original", "raw", "source", "input")) & ~read, "input_without_consumer")
        .when(~made, "no_producer")
        .when(~read, "no_consumer")
    )
    broken = table_roles(tables, uses).withColumn("rule", rule).filter("rule IS NOT NULL")
    by_rule = broken.select(
        "project",
        F.col("rule").alias("category"),
        F.when(F.col("rule") == "orphan_table", "MEDIUM").otherwise("LOW").alias("severity"),
        name.alias("subject"),
        F.lit("").alias("detail")
    )
    return reduce(
        DataFrame.unionByName,
        [
            _issues(lost, "task_without_workflow", "HIGH", F.col("code"), F.lit("")),
            _issues(empty, "workflow_without_tasks", "LOW", F.col("workflow"), F.lit("")),
            by_rule
        ]
    )


def match_rates(a: DataFrame | Dense, b: DataFrame | Dense, keys: list[str]) -> DataFrame:
    """By project: how many of b's keys a has, of how many, and the rate (1 where b has none). Edges by a rule are so on
    both sides."""
    on = ["project", *keys]
    if isinstance(a, Dense):
        none, n = F.lit(0).cast("long"), F.col("n")
        parts = (a.counts(), none, none), (b.counts(), n, none), (common_counts(a, b), none, n)
        rows = reduce(DataFrame.unionByName, [x.select("project", e.alias("expected"), m.alias("matched")) for x, e, m in parts])
        out = rows.groupBy("project").agg(F.sum("expected").alias("expected"), F.sum("matched").alias("matched"))
    else:
        both = a.select(on).distinct().withColumn("_a", F.lit(1)).join(b.select(on).distinct().withColumn("_b", F.lit(1)), on, "full")
        out = both.groupBy("project").agg(
            F.count_if(F.col("_b") == 1).alias("expected"),
            F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("matched")
        )
    return out.withColumn("rate", F.coalesce(F.try_divide("matched", "expected"), F.lit(1.0)))


def validate(graph: dict[str, DataFrame | Dense], scheduler: dict[str, DataFrame | Dense], tables: DataFrame | None, uses: DataFrame) -> DataFrame:
    """All issues between two snapshots (dicts of workflows, tasks and edges, and of calls and classes where there are any)
    and of the tables (None: those of the uses), with one schema. Tasks may have main_class; classes(project, class, task)."""
    edges = set_differences(graph["edges"], scheduler["edges"], ["source", "target"], "dependency")
    return reduce(DataFrame.unionByName, [*_checks(graph, scheduler, tables, uses), edges])


def issue_totals(graph: dict[str, DataFrame | Dense], scheduler: dict[str, DataFrame | Dense], tables: DataFrame | None, uses: DataFrame) -> DataFrame:
    """(project, category, severity, n): how many issues validate() has. Edges by a rule are counted from their nodes."""
    key, parts, a, b = ["project", "category", "severity"], _checks(graph, scheduler, tables, uses), graph["edges"], scheduler["edges"]
    if not isinstance(a, Dense):
        parts.append(set_differences(a, b, ["source", "target"], "dependency"))
    totals = [reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.count("*").alias("n"))]
    if isinstance(a, Dense):
        for n, kind, severity in ((minus_counts(b, a), "missing", "HIGH"), (minus_counts(a, b), "extra", "MEDIUM")):
            n = n.groupBy("project").agg(F.sum("n").alias("n")).filter("n > 0")
            totals.append(n.select("project", F.lit(f"dependency_{kind}").alias("category"), F.lit(severity).alias("severity"), "n"))
    return reduce(DataFrame.unionByName, totals)


def _checks(graph: dict[str, DataFrame | Dense], scheduler: dict[str, DataFrame | Dense], tables: DataFrame | None, uses: DataFrame) -> list[DataFrame]:
    """The issues of validate() but for those of the edges."""
    types = {"task_type": "task_type"}
    if "main_class" in graph["tasks"].columns and "main_class" in scheduler["tasks"].columns:
        types["main_class"] = "main_class"
    parts = [
        set_differences(graph["workflows"], scheduler["workflows"], ["code"], "workflow"),
        attribute_differences(graph["workflows"], scheduler["workflows"], "code", "name", "workflow_name"),
        several_differences(graph["tasks"], scheduler["tasks"], "code", types),
        count_differences(graph["tasks"], scheduler["tasks"], "workflow", "task_count"),
        table_checks(tables, uses),
    ]
    if "calls" in graph and "calls" in scheduler:
        parts.append(set_differences(graph["calls"], scheduler["calls"], ["source", "target"], "sub_workflow_call"))
    if "classes" in graph and "classes" in scheduler:
        parts.append(set_valued_differences(graph["classes"], scheduler["classes"], "class", "task", "class_tasks"))
    return parts


def all_rates(graph: dict[str, DataFrame | Dense], scheduler: dict[str, DataFrame | Dense]) -> DataFrame:
    """match_rates() of workflows, tasks and dependencies, with their kind."""
    keys = {"workflows": ["code"], "tasks": ["code"], "edges": ["source", "target"]}
    return reduce(DataFrame.unionByName, [match_rates(graph[k], scheduler[k], on).withColumn("kind", F.lit(k)) for k, on in keys.items()])
