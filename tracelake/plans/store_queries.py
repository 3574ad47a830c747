"""Queries over what is written to stores and read back, over catalogues with an index, and over condensed graphs."""

import uuid

from pyspark.sql import functions as F

from ..operators import graph, match, postings, quantiles, review, settings
from ..sources import files
from ..sources.store import Journal, KeyedTable
from .bindings import view
from .lineage_queries import _CLOSURE
from .registry import query


def _place(s) -> str:
    """A new folder that all executors share."""
    graph.checkpointed(s.range(0))  # names a folder in a local session that has none
    return f"{s.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, CAST(user_id AS VARCHAR) AS workflow_code, concat('t_', CAST(user_id % 7 AS VARCHAR)) AS task_code, count(*) AS n, CAST(sum(length(event_type)) AS BIGINT) AS n_chars
FROM events WHERE event_type <> 'view' GROUP BY ALL""")
def stored_logs(s, d):
    """Logs of which one batch is written again."""
    logs = view(s, d, "events").selectExpr(
        "CAST(CAST(ts AS DATE) AS STRING) AS dt", "CAST(user_id AS STRING) AS workflow_code", "concat('t/', user_id % 7) AS task_code", "CAST(event_id AS STRING) AS source", "nullif(event_type, 'view') AS text", "event_id % 2 AS half"
    )
    path = _place(s)
    for half in (0, 1, 0):
        files.write_logs(logs.filter(F.col("half") == half).drop("half"), path, f"half-{half}")
    by = Journal(s, path).read().groupBy("dt", "workflow_code", "task_code")
    return by.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("""SELECT CAST(user_id AS VARCHAR) AS candidate_id, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'approved' ELSE 'pending' END AS status, event_id % 3 = 1 AS in_second
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stored_decisions(s, d):
    """Decisions of all users in three batches, the last of them read out of order, and one of them read twice."""
    rows = view(s, d, "events").selectExpr(
        "CAST(user_id AS STRING) AS candidate_id",
        "CASE event_type WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'approved' ELSE 'pending' END AS status",
        "CAST(event_id % 3 AS STRING) AS reviewed_by",
        "struct(ts, event_id) AS reviewed_at",
        "CAST(NULL AS STRING) AS note"
    )
    stored = KeyedTable(s, _place(s), ("candidate_id",), buckets=8)
    for part in ("2", "0", "1", "0"):
        review.merge_decisions(stored, rows.filter(F.col("reviewed_by") == part), f"part-{part}")
    return stored.read().select("candidate_id", "status", (F.col("reviewed_by") == "1").alias("in_second"))


_EDITED = _CLOSURE.format(e="edited").replace("WITH RECURSIVE ", "WITH RECURSIVE edited AS (SELECT * FROM wf_edge WHERE CAST(source AS BIGINT) % 101 <> 50 UNION SELECT 'p', CAST(c_custkey AS VARCHAR), CAST(c_custkey + 3 AS VARCHAR) FROM customer WHERE c_custkey % 211 = 7 AND c_custkey + 3 <= (SELECT max(c_custkey) FROM customer)), ", 1)


def _edits(s, d):
    """Edges, some that come, and some that go, with codes as numbers."""
    edges = view(s, d, "wf_edge", "BIGINT")
    nodes = view(s, d, "customer").select(F.col("c_custkey").alias("k"))
    last = nodes.agg(F.max("k")).first()[0]
    come = nodes.filter((F.col("k") % 211 == 7) & (F.col("k") + 3 <= last)).select(F.lit("p").alias("project"), F.col("k").alias("source"), (F.col("k") + 3).alias("target"))
    gone = edges.filter(F.col("source") % 101 == 50)
    return edges, come.join(edges, ["project", "source", "target"], "left_anti"), gone


@query(_EDITED + " SELECT project, source, target FROM reach")
def edited_closure(s, d):
    """A stored closure, brought up to date after edges came and went."""
    edges, come, gone = _edits(s, d)
    index = files.closure_index(s, _place(s), 16)
    files.build_closure(index, edges, "built")
    files.edit_closure(index, edges, come, gone, "edited")
    return index.read().select("project", *(F.col(c).cast("string").alias(c) for c in ("source", "target")))


@query("""WITH RECURSIVE reach AS (SELECT project, source, target FROM loop_edge UNION SELECT r.project, r.source, e.target FROM reach r JOIN loop_edge e ON e.project = r.project AND e.source = r.target), n AS (SELECT project, source AS code FROM loop_edge UNION SELECT project, target FROM loop_edge)
SELECT n.project, n.code, coalesce(min(least(n.code, a.target)), n.code) AS component FROM n LEFT JOIN (SELECT a.* FROM reach a JOIN reach b ON a.project = b.project AND a.source = b.target AND a.target = b.source) a ON a.project = n.project AND a.source = n.code GROUP BY n.project, n.code""")
def components(s, d):
    return graph.strong_components(view(s, d, "loop_edge"))


@query("""WITH RECURSIVE reach AS (SELECT project, source, target FROM loop_edge WHERE source <> target UNION SELECT r.project, r.source, e.target FROM reach r JOIN loop_edge e ON e.project = r.project AND e.source = r.target)
SELECT project, source, target FROM reach WHERE source <> target""")
def expanded_closure(s, d):
    return graph.expanded(*graph.condensed_closure(view(s, d, "loop_edge")))


# Sixty rules, so that the literal index chooses; the smallest that matches counts.
@query("""WITH r AS (SELECT range AS k FROM range(60)) SELECT concat(log_id, '-', line_no) AS log_id, coalesce(CAST(min(k) AS VARCHAR), 'UNKNOWN') AS error_type FROM log_line LEFT JOIN r ON CASE WHEN k % 3 = 0 THEN regexp_matches(line, concat('Exception in task ', k, '\\d* ')) WHEN k % 3 = 1 THEN contains(line, concat('Stage ', k, ' finished')) ELSE regexp_matches(line, concat('java:', k, '\\d')) END GROUP BY log_id, line_no""")
def indexed_rule_matches(s, d):
    texts = view(s, d, "log_line").select(F.concat_ws("-", "log_id", "line_no").alias("log_id"), F.lit("SPARK").alias("task_type"), F.col("line").alias("text"))
    forms = (r"exception in task {k}\d* ", "stage {k} finished", r"(?:java|scala):{k}\d")
    rules = [("SPARK", "c", 1, k, str(k), forms[k % 3].format(k=k), "h") for k in range(60)]
    catalogue = s.createDataFrame(rules, "task_type string, category string, category_rank int, ord int, error_type string, pattern string, hint string")
    return match.match_rules(texts, catalogue).select("log_id", "error_type")


@query("""SELECT app, round(quantile_cont(duration, 0.5), 6) AS q50, round(quantile_cont(duration, 0.99), 6) AS q99 FROM task_run GROUP BY app""")
def merged_quantiles(s, d):
    """Quantiles of counts that were kept by stage."""
    tasks = view(s, d, "task_run")
    parts = [quantiles.value_counts(tasks.filter(F.col("stage") % 3 == k), ["app"], "duration") for k in range(3)]
    out = quantiles.quantiles(quantiles.merged_counts(parts, ["app"]), ["app"], {"q50": 0.5, "q99": 0.99})
    return out.select("app", F.round("q50", 6).alias("q50"), F.round("q99", 6).alias("q99"))


@query("""WITH u AS (SELECT DISTINCT project, table_name, workflow FROM table_use), r AS (SELECT *, (row_number() OVER (PARTITION BY project, table_name ORDER BY workflow) - 1) // 3 AS block, count(*) OVER (PARTITION BY project, table_name) AS n FROM u)
SELECT project, table_name, block, n, string_agg(workflow, ',' ORDER BY workflow) AS members FROM r GROUP BY ALL""")
def table_user_blocks(s, d):
    blocks = postings.posting_blocks(view(s, d, "end_use"), ["project", "table_name"], "workflow", 3)
    return blocks.select("project", "table_name", "block", "n", F.array_join("members", ",").alias("members"))


# A line of each of eight forms by event, in logs of five types: a form is a setting of some of the types.
@query("""WITH x AS (SELECT event_id, user_id % 5 AS t, event_id % 8 AS f FROM events)
SELECT CAST(event_id AS VARCHAR) AS log_id FROM x WHERE (t = 0 AND f IN (0, 1)) OR (t = 1 AND f = 2) OR (t = 3 AND f = 4) OR (t IN (2, 4) AND f IN (0, 2, 3, 5))""")
def typed_settings(s, d):
    forms = ("--conf spark.x={id}", "spark.memory: {id}", '"channel": {id}', "bash run{id}", "SELECT {id}", "yarn.address={id}", "--conf spark.x={id} at a.b(", "nothing {id}")
    e = view(s, d, "events")
    line = F.element_at(F.array(*(F.replace(F.lit(x), F.lit("{id}"), F.col("event_id").cast("string")) for x in forms)), (F.col("event_id") % 8 + 1).cast("int"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("SPARK", "datax", "other", "HIVE", "none"))), (F.col("user_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("user_id") % 5 != 4, kind)
    rows = e.select(F.col("event_id").cast("string").alias("log_id"), kind.alias("task_type"), F.lit(1).alias("line_no"), line.alias("line"))
    return settings.setting_lines(rows).select("log_id")
