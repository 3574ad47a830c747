"""Sources and sinks: lineage graphs, definitions, logs, event logs, listings, catalogues, audit and reports."""

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from .store import Journal, KeyedTable

_EDGES = (
    "workflow_contains_task",
    "workflow_depends_workflow",
    "task_depends_task",
    "calls_subworkflow",
    "task_executes_class",
    "task_produces_table",
    "task_consumes_table"
)
_EDGE = "array<struct<source: string, target: string, `from`: string, `to`: string, pre: string, post: string, workflow: string, task: string, `table`: string, parent: string, child: string, task_code: string>>"
GRAPH = (
    "project_code string, scanned_at string, nodes struct<workflows: array<struct<code: string, name: string, schedule_type: string, schedule_cron: string, is_sub_workflow: boolean, parent_workflow: string>>,"
    " tasks: array<struct<code: string, name: string, workflow_code: string, task_type: string, spark_main_class: string>>, tables: array<struct<full_name: string, table_type: string>>,"
    " classes: array<struct<name: string, file_path: string, cross_project: boolean, tables_input: array<string>, tables_output: array<string>>>>,"
    f" edges struct<{', '.join(f'{e}: {_EDGE}' for e in _EDGES)}>"
)


def read_graphs(spark: SparkSession, path: str, depends_direction: str = "as_stored") -> dict[str, DataFrame]:
    """Node tables and one edge table of all projects' graph documents; edge keys under any of their names."""
    docs = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    out = {
        k: docs.select(
            F.col("project_code").alias("project"),
            F.explode(f"nodes.{k}").alias("n")
        ).select("project", "n.*") for k in ("workflows", "tasks", "tables", "classes")
    }
    edges = None
    for kind in _EDGES:
        e = docs.select(F.col("project_code").alias("project"), F.lit(kind).alias("edge_type"), F.explode(f"edges.{kind}").alias("e"))
        source, target = F.coalesce(
            "e.source",
            "e.from",
            "e.pre",
            "e.parent",
            "e.workflow",
            "e.task"
        ), F.coalesce("e.target", "e.to", "e.post", "e.child", "e.table", "e.task")
        if kind == "workflow_depends_workflow" and depends_direction == "reversed":
            source, target = target, source
        e = e.select("project", "edge_type", source.alias("source"), target.alias("target"))
        edges = e if edges is None else edges.unionByName(e)
    return out | {"edges": edges}


def write_by_project(df: DataFrame, path: str) -> None:
    """Replace the partitions of the projects in df."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


#: The indexes that are kept, with the columns that tell them apart.
INDEXES = {"downstream": "direct", "table_users": "table_name", "workflow_nodes": "tasks"}


def write_index(df: DataFrame, base: str, kind: str) -> None:
    """Store an index of INDEXES for the projects in df."""
    if INDEXES[kind] not in df.columns:
        raise ValueError(f"this isn't the index {kind}: it has no {INDEXES[kind]}")
    write_by_project(df, f"{base}/{kind}")


def read_index(spark: SparkSession, base: str, kind: str, project: str | None = None) -> DataFrame:
    """A stored index; of one project if named, of which only the partition is read."""
    if kind not in INDEXES:
        raise ValueError(f"no index {kind}")
    out = spark.read.parquet(f"{base}/{kind}").withColumn("project", F.col("project").cast("string"))
    return out.filter(F.col("project") == project) if project is not None else out


def closure_index(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The stored closure (project, source, target, depth): the rows of a source are in one bucket."""
    return KeyedTable(spark, path, ("project", "source", "target"), ("project", "source"), buckets)


def build_closure(index: KeyedTable, edges: DataFrame, batch: str) -> int | None:
    found = graph.closure(edges)
    return index.replace(edges.select("project", "source"), found, batch)


def edit_closure(index: KeyedTable, edges: DataFrame, added: DataFrame, removed: DataFrame, batch: str) -> int | None:
    """Bring a stored closure of edges up to date when some go and come: only the sources whose reach changes are written,
    and only their buckets."""
    rows, sources = graph.edited_closure(index.read(), edges, added, removed)
    return index.replace(sources, rows, batch)


def projects(df: DataFrame) -> DataFrame:
    return df.select("project").distinct()


_WORKFLOW = "struct<code: string, name: string, schedule: struct<crontab: string, startTime: string, endTime: string, timezoneId: string>>"
_TASKS = "array<struct<code: string, name: string, taskType: string, taskParams: string>>"
_RELATIONS = "array<struct<preTaskCode: string, postTaskCode: string>>"
_DETAIL = f"struct<workflow: {_WORKFLOW}, workflowDefinition: {_WORKFLOW}, tasks: {_TASKS}, taskDefinitionList: {_TASKS}, relations: {_RELATIONS}, workflowTaskRelationList: {_RELATIONS}>"


def parse_definitions(definitions: DataFrame) -> dict[str, DataFrame]:
    """Workflows, tasks and edges of definitions (project_code, response), in either spelling, alone or in `data`."""
    d = definitions.select(
        F.col("project_code").alias("project"),
        F.coalesce(F.from_json("response", f"struct<data: {_DETAIL}>")["data"], F.from_json("response", _DETAIL)).alias("d")
    )
    w = F.coalesce("d.workflow", "d.workflowDefinition")
    cron = w["schedule"]["crontab"]
    d = d.withColumn("w", w).filter("w.code IS NOT NULL")
    workflows = d.select(
        "project",
        F.col("w.code").alias("code"),
        F.col("w.name").alias("name"),
        F.when(F.coalesce(F.length(cron), F.lit(0)) > 0, "CRON").otherwise("MANUAL").alias("schedule_type"),
        cron.alias("schedule_cron"),
        F.coalesce("w.schedule.timezoneId", F.lit("Asia/Shanghai")).alias("timezone")
    )
    tasks = d.select("project", F.col("w.code").alias("workflow"), F.explode(F.coalesce("d.tasks", "d.taskDefinitionList")).alias("t")).filter("t.code IS NOT NULL").select(
        "project",
        F.col("t.code").alias("code"),
        F.col("t.name").alias("name"),
        "workflow",
        F.col("t.taskType").alias("task_type"),
        F.col("t.taskParams").alias("params")
    )
    contains = tasks.select(
        "project",
        F.lit("workflow_contains_task").alias("edge_type"),
        F.col("workflow").alias("source"),
        F.col("code").alias("target")
    )
    rel = d.select(
        "project",
        F.explode(F.coalesce("d.relations", "d.workflowTaskRelationList")).alias("r")
    ).filter("r.preTaskCode IS NOT NULL AND r.preTaskCode != '0'")
    edges = contains.unionByName(
        rel.select(
            "project",
            F.lit("task_depends_task").alias("edge_type"),
            F.col("r.preTaskCode").alias("source"),
            F.col("r.postTaskCode").alias("target")
        )
    )
    return {"workflows": workflows, "tasks": tasks, "edges": edges}


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) of whole files; those that can't be read, or have gone, are left out."""
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_logs(spark: SparkSession, base: str) -> DataFrame:
    """Logs under base/date/workflow/task/name.log, with what the path says."""
    p = F.col("path")
    part = lambda k: F.element_at(F.split(p, "/"), -k)
    return read_texts(spark, base).select(
        part(4).alias("dt"),
        part(3).alias("workflow_code"),
        part(2).alias("task_code"),
        F.regexp_replace(part(1), r"\.log$", "").alias("source"),
        F.col("content").alias("text")
    )


def safe_part(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\w-]", "_")


def _appended(rows: DataFrame, path: str, partition_by: tuple[str, ...], batch: str | None) -> None:
    """With a batch, rows go to a journal (see store) that takes it once; without, they are simply added."""
    if batch is None:
        rows.write.mode("append").partitionBy(*partition_by).json(path)
    else:
        Journal(rows.sparkSession, path).append(rows, batch, partition_by)


def write_logs(logs: DataFrame, path: str, batch: str | None = None) -> None:
    """Non-empty logs by date, workflow and task; path parts hold only word characters and dashes.

    A batch that is written again is stored once; its folders are dates only, as there is one for every task otherwise.
    """
    kept = logs.filter(F.length(F.coalesce("text", F.lit(""))) > 0)
    kept = kept.withColumns({c: safe_part(F.col(c)) for c in ("workflow_code", "task_code")})
    _appended(kept, path, ("dt",) if batch else ("dt", "workflow_code", "task_code"), batch)


def log_metadata(logs: DataFrame) -> DataFrame:
    """A row for each date, workflow and task that write_logs() stores: sources and characters of its logs."""
    kept = logs.filter(F.length(F.coalesce("text", F.lit(""))) > 0)
    return kept.groupBy("dt", "workflow_code", "task_code").agg(
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.sum(F.length("text")).alias("n_chars")
    )


def latest_logs(logs: DataFrame) -> DataFrame:
    """The newest date's logs of each workflow and task."""
    rank = F.rank().over(Window.partitionBy("workflow_code", "task_code").orderBy(F.desc("dt")))
    return logs.withColumn("_r", rank).filter("_r = 1").drop("_r")


def retained(logs: DataFrame, today: Column, days: int = 7) -> DataFrame:
    return logs.filter(F.col("dt").cast("date") >= F.date_sub(today, days))


def drop_old(spark: SparkSession, path: str, today: str, days: int = 7) -> int:
    """Delete the date partitions (dt=...) under path that are older; returns how many. Only their names are read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    oldest = (date.fromisoformat(today) - timedelta(days)).isoformat()
    old = [
        x.getPath() for x in files.listStatus(folder) if x.isDirectory() and re.fullmatch(r"dt=\d{4}-\d{2}-\d{2}", x.getPath().getName()) and x.getPath().getName()[3:] < oldest
    ]
    for p in old:
        files.delete(p, True)
    return len(old)


def n_dropped_days(logs: DataFrame, today: Column, days: int = 7) -> DataFrame:
    return logs.filter(F.col("dt").cast("date") < F.date_sub(today, days)).agg(F.countDistinct("dt").alias("n_dropped"))


_METRICS = (
    "struct<`Input Metrics`: struct<`Bytes Read`: long>, `Shuffle Read Metrics`: struct<`Remote Bytes Read`: long>,"
    " `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: long>, `Memory Bytes Spilled`: long>"
)
_STAGE = (
    "struct<`Stage ID`: long, `Stage Name`: string, Name: string, `Number of Tasks`: long, `Submission Time`: long, `Completion Time`: long,"
    " `Failure Reason`: string, `Number of Failed Tasks`: long, Accumulables: array<struct<Name: string, Value: string>>>"
)
_TASK = "struct<`Task ID`: long, Attempt: long, `Executor ID`: string, Host: string, Duration: long>"
_PROPERTIES = "map<string, string>"
EVENT = (
    "Event string, `Job ID` long, `Stage IDs` array<long>, Description string, `Submission Time` long, `Completion Time` long, `Job Result` struct<Result: string>,"
    " `Executor ID` string, `Executor Info` struct<Host: string, `Total Cores`: long, Memory: long>, Timestamp long, Time long, `Removed Reason` string,"
    f" `Stage ID` long, `Task Info` {_TASK}, `Task Metrics` {_METRICS}, `Task End Reason` struct<Reason: string, Failure: struct<ClassName: string>, Description: string>,"
    f" `Stage Info` {_STAGE}, `Spark Properties` {_PROPERTIES}, `Environment Details` struct<`Spark Properties`: {_PROPERTIES}>"
)


def parse_events(lines: DataFrame) -> DataFrame:
    """Event-log lines (app, line_no, line) as columns; lines that aren't JSON objects are left out."""
    e = F.from_json("line", EVENT)
    return lines.filter(F.col("line").startswith("{")).select("app", "line_no", e.alias("e")).filter("e.Event IS NOT NULL").select("app", "line_no", "e.*")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of all logs under path; the app is the file's name. line_no is the file, where the part of it that a task reads
    begins, and the order within it, so that it tells a log's order however files are split and dealt."""
    raw = spark.read.text(path).select(
        F.regexp_extract(F.element_at(F.split("_metadata.file_path", "/"), -1), r"^([^.]+)", 1).alias("app"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("line_no"),
        F.col("value").alias("line")
    )
    return parse_events(raw)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of all files under path; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path",
        "length",
        F.col("modificationTime").alias("modified")
    )


# Headings of rule catalogues by category, in order of precedence.
CATEGORIES = {"AUTO_FIXABLE": 1, "KNOWN_NEEDS_LLM": 2}


def parse_catalogue(lines: DataFrame) -> DataFrame:
    """Rules from Markdown lines (task_type, line_no, line): tables of type, `pattern` and hint under category headings.

    A pattern may hold a bar, so it is lifted out by its back-ticks before the row is split. An unknown heading ends the
    category. The window goes over one catalogue, which is small.
    """
    heading = F.regexp_extract("line", r"^##\s+(.*)$", 1)
    category = F.when(F.upper(heading).contains("AUTO"), "AUTO_FIXABLE").when(F.upper(heading).contains("LLM"), "KNOWN_NEEDS_LLM").when(heading != "", "")
    by = Window.partitionBy("task_type").orderBy("line_no")
    rows = lines.withColumn("category", F.last(category, ignorenulls=True).over(by)).withColumn(
        "sub_category",
        F.last(F.nullif(F.regexp_extract("line", r"^###\s+(.*)$", 1), F.lit("")), ignorenulls=True).over(by)
    )
    pattern = F.regexp_extract("line", r"`([^`]+)`", 1)
    cells = F.split(F.regexp_replace("line", r"`[^`]+`", "PATTERN"), r"\|")
    found = rows.filter(F.col("line").startswith("|") & (pattern != "") & (F.coalesce(F.col("category"), F.lit("")) != ""))
    rank = F.when(F.col("category") == "AUTO_FIXABLE", 1).otherwise(2)
    return found.select(
        "task_type",
        "category",
        rank.alias("category_rank"),
        "sub_category",
        F.col("line_no").alias("ord"),
        F.trim(F.get(cells, F.lit(1))).alias("error_type"),
        pattern.alias("pattern"),
        F.trim(F.get(cells, F.lit(3))).alias("hint")
    )


KNOWLEDGE = "id string, task_type string, error_type string, pattern string, solution string, auto_fix boolean, status string, correction string, confirmed_at string"


def read_knowledge(spark: SparkSession, base: str) -> DataFrame:
    """Entries of base/<task type>/confirmed.json and pending.json: the path says type and status where an entry doesn't."""
    raw = spark.read.schema(KNOWLEDGE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(base)
    parts = F.split(F.col("_metadata.file_path"), "/")
    status = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")
    return raw.withColumns({"task_type": F.upper(F.coalesce("task_type", F.element_at(parts, -2))), "status": F.coalesce("status", status)})


def write_knowledge(entries: DataFrame, base: str) -> None:
    """Replace the entries of the task types and states in `entries`, a folder for each."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_type", "status").json(base)


def audit_rows(operations: DataFrame, most: int = 500) -> DataFrame:
    """Operations as audit rows: details cut to `most` characters, and the date that they are stored under."""
    cut = {c: F.substring(F.col(c), 1, most) for c in ("operation_detail", "result_detail") if c in operations.columns}
    return operations.withColumns(cut).withColumn("dt", F.to_date("timestamp"))


def write_audit(operations: DataFrame, path: str, batch: str | None = None) -> None:
    _appended(audit_rows(operations), path, ("dt",), batch)


def write_reports(nested: DataFrame, path: str, batch: str | None = None) -> None:
    _appended(nested, path, ("dt",) if batch else ("dt", "workflow_code"), batch)


def graph_export(nodes: DataFrame, edges: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """One nested record a project for a viewer: sorted nodes, tasks (code, workflow) and edges, and how many there are."""
    n = nodes.groupBy("project").agg(F.array_sort(F.collect_set("code")).alias("nodes"))
    e = edges.groupBy("project").agg(F.array_sort(F.collect_set(F.struct("source", "target"))).alias("edges"))
    out = n.join(e, "project", "left")
    if tasks is not None:
        out = out.join(tasks.groupBy("project").agg(F.array_sort(F.collect_set(F.struct("code", "workflow"))).alias("tasks")), "project", "left")
        out = out.withColumn("n_tasks", F.coalesce(F.array_size("tasks"), F.lit(0)).cast("long"))
    return out.withColumn("n_nodes", F.size("nodes").cast("long")).withColumn("n_edges", F.coalesce(F.array_size("edges"), F.lit(0)).cast("long"))


def issue_report(issues: DataFrame) -> DataFrame:
    """A project's issues as one record: how many there are, and of each severity, and the issues themselves in order."""
    rows = [c for c in ("category", "severity", "subject", "detail") if c in issues.columns]
    listed = F.array_sort(F.collect_list(F.struct(*rows))).alias("issues")
    return issues.groupBy("project").agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("HIGH", "MEDIUM", "LOW")),
        listed
    )
