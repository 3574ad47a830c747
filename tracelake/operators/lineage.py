"""Lineage between workflows, tasks and tables: lookups, roles, table-based dependencies, indexes and counts.

Columns: workflows(project, code, name), tasks(project, code, workflow, task_type), uses(project, workflow, task,
table_name, role) with role `produce` or `consume`, edges(project, source, target) from upstream to downstream.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import embedded_sql, sql_sources, sql_targets
from .dense import Dense

# What table names say of their layer, and workflow names of tests and copies.
OUTPUT_TOKENS = ("ads", "dws", "report", "result", "output")
INPUT_TOKENS = ("ods", "dwd", "original", "raw", "source", "input")
TEST_TOKENS = ("test", "copy", "_copy_", "agent-test", "测试")


def names_any(column: Column, tokens: tuple[str, ...]) -> Column:
    return F.lower(column).rlike("|".join(t.replace("-", r"\-") for t in tokens))


def lookup(nodes: DataFrame, project: str, code: str) -> DataFrame:
    """One workflow or task; the filter reaches the scan."""
    return nodes.filter((F.col("project") == project) & (F.col("code") == code))


def with_sub_workflows(workflows: DataFrame, calls: DataFrame) -> DataFrame:
    """Workflows with the sorted codes of the sub-workflows that they call."""
    subs = calls.groupBy("project", F.col("source").alias("code")).agg(F.array_sort(F.collect_set("target")).alias("sub_workflows"))
    return workflows.join(subs, ["project", "code"], "left").withColumn("sub_workflows", F.coalesce("sub_workflows", F.array().cast("array<string>")))


def is_test(name: Column) -> Column:
    return names_any(name, TEST_TOKENS)


def roles(workflows: DataFrame, calls: DataFrame) -> DataFrame:
    """workflows with role: test by name, else main (calls another), child (called), or independent."""
    ends = calls.select("project", F.col("source").alias("code"), F.lit(1).alias("calls"), F.lit(0).alias("called")).unionByName(
        calls.select("project", F.col("target").alias("code"), F.lit(0).alias("calls"), F.lit(1).alias("called"))
    )
    flags = ends.groupBy("project", "code").agg(F.max("calls").alias("calls"), F.max("called").alias("called"))
    role = F.when(is_test(F.col("name")), "test").when(F.col("calls") == 1, "main").when(F.col("called") == 1, "child").otherwise("independent")
    return workflows.join(flags, ["project", "code"], "left").withColumn("role", role).drop("calls", "called")


def lasting(table_name: Column) -> Column:
    """Whether a table is neither temporary, nor a view, nor a path."""
    return ~F.lower(table_name).rlike("view|temp") & ~table_name.startswith("hdfs:")


def layer(table_name: Column) -> Column:
    return F.when(names_any(table_name, OUTPUT_TOKENS), "output").when(names_any(table_name, INPUT_TOKENS), "input").otherwise("other")


def uses_by_workflow(task_uses: DataFrame, tasks: DataFrame) -> DataFrame:
    """Uses of tables by tasks, with the workflow of each task; uses by unknown tasks are dropped."""
    owner = tasks.select("project", F.col("code").alias("task"), "workflow")
    return task_uses.join(owner, ["project", "task"])


def implicit_dependencies(uses: DataFrame, explicit: DataFrame | Dense, input_tokens: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs of workflows of a project that share a table which one produces and the other consumes.

    (project, upstream, downstream, via_tables, first_table, n_tables, is_explicit, risk). A workflow counts once for a
    table before the join, whose rows are then producers times consumers of each table. input_tokens restricts what counts
    as consumed. Whether a pair is among edges by a rule is told from its two ends; the edges aren't made.
    """
    ends = uses.select("project", "workflow", "table_name", "role").distinct()
    made = ends.filter("role = 'produce'").select("project", "table_name", F.col("workflow").alias("upstream"))
    read = ends.filter("role = 'consume'").select("project", "table_name", F.col("workflow").alias("downstream"))
    if input_tokens:
        read = read.filter(names_any(F.col("table_name"), input_tokens))
    pairs = made.join(read, ["project", "table_name"]).filter("upstream != downstream")
    pairs = pairs.groupBy("project", "upstream", "downstream").agg(F.array_sort(F.collect_set("table_name")).alias("via_tables"))
    if isinstance(explicit, Dense):
        flagged = explicit.flagged(pairs, "upstream", "downstream", "is_explicit")
    else:
        known = explicit.select(
            "project",
            F.col("source").alias("upstream"),
            F.col("target").alias("downstream")
        ).distinct().withColumn("_known", F.lit(True))
        flagged = pairs.join(known, ["project", "upstream", "downstream"], "left").withColumn("is_explicit", F.coalesce("_known", F.lit(False))).drop("_known")
    return flagged.select(
        "*",
        F.col("via_tables")[0].alias("first_table"),
        F.size("via_tables").alias("n_tables"),
        F.when(F.col("is_explicit"), "LOW").otherwise("MEDIUM").alias("risk")
    )


def missing_dependencies(implicit: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Implicit dependencies that aren't declared: by the flag that they carry, or by another table of declared ones."""
    if explicit is None:
        return implicit.filter("NOT is_explicit")
    known = explicit.select("project", F.col("source").alias("upstream"), F.col("target").alias("downstream"))
    return implicit.join(known, ["project", "upstream", "downstream"], "left_anti")


def independent_dependencies(uses: DataFrame, with_roles: DataFrame, explicit: DataFrame | Dense) -> DataFrame:
    """Implicit dependencies of independent consumers on producers that aren't tests, by lasting tables only.

    has_dependent_task tells whether the dependency is declared; the rest is missing.
    """
    who = with_roles.select("project", F.col("code").alias("workflow"), F.col("role").alias("workflow_role"))
    kept = uses.filter(lasting(F.col("table_name"))).join(who, ["project", "workflow"])
    kept = kept.filter("(role = 'produce' AND workflow_role != 'test') OR (role = 'consume' AND workflow_role = 'independent')")
    return implicit_dependencies(kept, explicit).withColumnRenamed("is_explicit", "has_dependent_task").drop("risk")


def calls_with_names(calls: DataFrame, workflows: DataFrame) -> DataFrame:
    ends = [workflows.select("project", F.col("code").alias(c), F.col("name").alias(f"{c}_name")) for c in ("source", "target")]
    out = calls
    for c, names in zip(("source", "target"), ends):
        out = out.join(names, ["project", c], "left").withColumn(f"{c}_name", F.coalesce(f"{c}_name", F.lit("")))
    return out


def dependents(tasks: DataFrame, params_col: str = "params") -> DataFrame:
    """Dependencies that DEPENDENT tasks declare in any of three shapes, with is_empty for those without."""
    params = F.from_json(
        params_col,
        "processDefinitionCode string, dependence struct<dependTaskList: array<struct<processDefinitionCode: string, definitionCode: string, dependItemList: array<struct<definitionCode: string, processDefinitionCode: string>>>>>"
    )
    lists = F.coalesce(F.col("p.dependence.dependTaskList"), F.array())
    nested = F.flatten(
        F.transform(
            lists,
            lambda x: F.transform(F.coalesce(x.dependItemList, F.array()), lambda y: F.coalesce(y.definitionCode, y.processDefinitionCode))
        )
    )
    codes = F.concat(F.array("p.processDefinitionCode"), F.transform(lists, lambda x: F.coalesce(x.processDefinitionCode, x.definitionCode)), nested)
    found = tasks.filter("task_type = 'DEPENDENT'").withColumn("p", params)
    found = found.select("project", "code", "workflow", F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))).alias("depends_on"))
    return found.withColumn("is_empty", F.size("depends_on") == 0)


def code_projects(names: DataFrame, mapping: DataFrame, name_col: str = "project_name") -> DataFrame:
    """names with code_project: what mapping (project_name, code_project) says, else the name with dashes for underscores."""
    known = mapping.select(F.col("project_name").alias(name_col), "code_project")
    return names.join(known, name_col, "left").withColumn("code_project", F.coalesce("code_project", F.replace(name_col, F.lit("_"), F.lit("-"))))


def class_uses(class_files: DataFrame, files: DataFrame) -> DataFrame:
    """(project, class, task, table_name, role): tables that the SQL in the file of a task's class names.

    class_files(project, class, task, path) as match.best_class_file() finds them, files(path, content). A table that one
    file names twice counts once.
    """
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    named = lambda tables, role: F.transform(tables, lambda x: F.struct(x.alias("table_name"), F.lit(role).alias("role")))
    # Each file is read once, by path, as the join needs it, so that a few large inputs are the work of all tasks. A plain
    # explode would read it again for a filter that Spark derives from it.
    strings = files.select("path", "content").repartition("path").select("path", F.explode_outer(embedded_sql(extension, F.col("content"))).alias("sql"))
    both = F.concat(named(sql_targets(F.col("sql")), "produce"), named(sql_sources(F.col("sql")), "consume"))
    found = strings.select("path", F.explode_outer(both).alias("_u")).filter("_u IS NOT NULL").select("path", "_u.table_name", "_u.role")
    return class_files.join(found, "path").select("project", "class", "task", "table_name", "role").distinct()


def merged_uses(*results: DataFrame) -> DataFrame:
    """Uses of tables from several extractions, each once; an extraction that is given again isn't made again."""
    columns = ("project", "task", "table_name", "role")
    different: list[DataFrame] = []
    for r in (r.select(*columns) for r in results):
        if not any(r.sameSemantics(x) for x in different):
            different.append(r)
    return reduce(DataFrame.unionByName, different).distinct()


def table_users(uses: DataFrame, table_name: str | None = None, role: str | None = None) -> DataFrame:
    """Index: the distinct workflows and tasks, and classes where uses have any, of each (project, table, role); one table
    or role if named."""
    rows = uses
    if table_name is not None:
        rows = rows.filter(F.col("table_name") == table_name)
    if role is not None:
        rows = rows.filter(F.col("role") == role)
    kinds = {"workflow": "workflows", "task": "tasks", "class": "classes"}
    members = [F.array_sort(F.collect_set(c)).alias(to) for c, to in kinds.items() if c in uses.columns]
    return rows.groupBy("project", "table_name", "role").agg(*members)


def cross_project_lineage(uses: DataFrame, table_name: str, classes: DataFrame | None = None) -> DataFrame:
    """Who makes and who reads a table, in all projects; with class_uses(), also the classes that name it, as role `class`."""
    found = uses.filter(F.col("table_name") == table_name).select("role", "project", "workflow", "task")
    if classes is not None:
        named = classes.filter(F.col("table_name") == table_name)
        found = found.unionByName(named.select(F.lit("class").alias("role"), "project", F.col("class").alias("workflow"), "task"))
    return found.distinct()


def cross_project_downstream(uses: DataFrame) -> DataFrame:
    """(project, workflow) -> (to_project, to_workflow) in another project, with the tables in between."""
    ends = uses.select("project", "workflow", "table_name", "role").distinct()
    made = ends.filter("role = 'produce'").select("project", "workflow", "table_name")
    read = ends.filter("role = 'consume'").select(F.col("project").alias("to_project"), F.col("workflow").alias("to_workflow"), "table_name")
    pairs = made.join(read, "table_name").filter("project != to_project")
    return pairs.groupBy("project", "workflow", "to_project", "to_workflow").agg(F.array_sort(F.collect_set("table_name")).alias("via_tables"))


def with_name(df: DataFrame, code_col: str, workflows: DataFrame, to: str) -> DataFrame:
    """df with the name of a workflow, or its code where the name is unknown."""
    names = workflows.select("project", F.col("code").alias(code_col), F.col("name").alias(to))
    return df.join(names, ["project", code_col], "left").withColumn(to, F.coalesce(to, F.col(code_col)))


def workflow_nodes(workflows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks of each workflow, with maps of their types, and of their names and classes where tasks have any; workflows
    without tasks stay."""
    maps = {c: to for c, to in (("task_type", "task_types"), ("name", "task_names"), ("main_class", "task_classes")) if c in tasks.columns}
    by = tasks.groupBy("project", F.col("workflow").alias("code")).agg(F.array_sort(F.collect_list(F.struct("code", *maps))).alias("_t"))
    out = workflows.select("project", "code").join(by, ["project", "code"], "left")
    kind = next(f.dataType.simpleString() for f in out.schema if f.name == "_t")
    listed = F.coalesce("_t", F.array().cast(kind))
    pairs = (F.map_from_arrays(_part(listed, "code"), _part(listed, c)).alias(to) for c, to in maps.items())
    return out.select("project", "code", _part(listed, "code").alias("tasks"), *pairs)


def _part(listed: Column, field: str) -> Column:
    return F.transform(listed, lambda x: x[field])


def project_summary(workflows: DataFrame, tasks: DataFrame, uses: DataFrame) -> DataFrame:
    """Counts of workflows, tasks and tables by project, with a grand total whose project is null."""
    rows = workflows.select("project", F.lit("w").alias("kind"), "code").unionByName(tasks.select("project", F.lit("t").alias("kind"), "code")).unionByName(
        uses.select("project", F.lit("b").alias("kind"), F.col("table_name").alias("code"))
    )
    rows = rows.distinct()
    return rows.rollup("project").agg(
        F.count_if(F.col("kind") == "w").alias("n_workflows"),
        F.count_if(F.col("kind") == "t").alias("n_tasks"),
        F.countDistinct(F.when(F.col("kind") == "b", F.col("code"))).alias("n_tables")
    )


def role_counts(with_roles: DataFrame, **edges: DataFrame | Dense) -> DataFrame:
    """Workflows by project and role; for each of edges, such as calls or missing dependencies (all with project), how many
    there are as n_<name>."""
    out = with_roles.groupBy("project").agg(
        *(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("main", "child", "independent", "test")),
        F.count("*").alias("n_workflows"),
    )
    for name, rows in edges.items():
        n = rows.counts().groupBy("project").agg(F.sum("n").alias(f"n_{name}")) if isinstance(rows, Dense) else rows.groupBy("project").agg(F.count("*").alias(f"n_{name}"))
        out = out.join(n, "project", "left")
    return out.fillna(0, [f"n_{name}" for name in edges])


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues by category and severity, with all totals (null for any)."""
    return issues.cube("category", "severity").agg(F.count("*").alias("n"))


def first_of(df: DataFrame, list_col: str, n: int) -> DataFrame:
    """A sorted list cut to its first n, with how many were left out."""
    return df.withColumn("shown", F.slice(F.array_sort(list_col), 1, n)).withColumn("n_more", F.greatest(F.size(list_col) - n, F.lit(0)))
