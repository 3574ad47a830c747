"""Log, text and rule-matching queries over the supplied tables."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import logs, match
from .bindings import view
from .registry import query

J = lambda c: F.array_join(c, ",").alias(c)
R = lambda c: F.round(c, 6).alias(c)

# In the bound logs an ERROR line starts a block, causes and frames extend it, and the rest breaks.
_BLOCKS = """k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'break' WHEN line LIKE 'ERROR%' THEN 'start' WHEN line LIKE 'Caused by%' THEN 'hard' WHEN trim(line) LIKE 'at %' THEN 'soft' ELSE 'break' END AS kind FROM log_line),
runs AS (SELECT *, sum(CASE WHEN kind IN ('start', 'break') THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no) AS run FROM k),
f AS (SELECT *, first_value(kind) OVER (PARTITION BY log_id, run ORDER BY line_no) AS fk, row_number() OVER (PARTITION BY log_id, run ORDER BY line_no) AS n FROM runs),
blocks AS (SELECT log_id, min(line_no) AS pos, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS block FROM f WHERE fk = 'start' AND (kind <> 'soft' OR n <= 30) GROUP BY log_id, run)"""


@query("WITH " + _BLOCKS + " SELECT log_id, pos, n_lines, md5(block) AS block_md5 FROM blocks")
def error_blocks(s, d):
    return logs.error_blocks(view(s, d, "log_line")).select("log_id", "pos", "n_lines", F.md5("block").alias("block_md5"))


@query(
    "WITH " + _BLOCKS + """, b AS (SELECT log_id, pos, CASE WHEN contains(block, 'OutOfMemoryError') THEN 10 ELSE 7 END AS score FROM blocks) SELECT log_id, pos, score, row_number() OVER (PARTITION BY log_id ORDER BY score DESC, pos) AS rank FROM b"""
)
def ranked_blocks(s, d):
    return logs.ranked(logs.error_blocks(view(s, d, "log_line"))).select("log_id", "pos", "score", "rank")


@query("WITH " + _BLOCKS + """, b AS (SELECT log_id, pos, regexp_extract(block, '(java|org|com)\\.[a-z]+\\.[A-Z][a-zA-Z]*', 0) AS a FROM blocks), c AS (SELECT log_id, pos, CASE WHEN a <> '' THEN a ELSE 'OutOfMemoryError' END AS exception_type FROM b)
SELECT log_id, exception_type, min(pos) AS pos FROM c GROUP BY ALL""")
def first_blocks_of_type(s, d):
    return logs.first_of_type(logs.error_blocks(view(s, d, "log_line"))).select("log_id", "exception_type", "pos")


@query("WITH " + _BLOCKS + """, c AS (SELECT log_id, pos, block, regexp_extract_all(block, 'Caused by:\\s*([^\\n]+)', 1) AS causes FROM blocks)
SELECT log_id, pos, trim(CASE WHEN len(causes) > 0 THEN causes[-1] ELSE split_part(block, chr(10), 1) END) AS root_cause FROM c""")
def root_causes(s, d):
    return logs.error_blocks(view(s, d, "log_line")).select("log_id", "pos", logs.root_cause(F.col("block")).alias("root_cause"))


# Logs of ten lines for each user, of which some warn.
@query("WITH " + _BLOCKS + """, w AS (SELECT log_id, count(*) AS n FROM log_line WHERE line_no % 10 = 3 AND line <> '' GROUP BY log_id)
SELECT l.log_id, coalesce(b.n, 0) AS n_blocks, coalesce(w.n, 0) AS n_warnings FROM (SELECT DISTINCT log_id FROM log_line) l LEFT JOIN (SELECT log_id, count(*) AS n FROM blocks GROUP BY log_id) b USING (log_id) LEFT JOIN w USING (log_id)""")
def error_summary(s, d):
    line = F.when((F.col("line_no") % 10 == 3) & (F.col("line") != ""), F.concat("line", F.lit(" Low memory"))).otherwise(F.col("line"))
    return logs.error_summary(view(s, d, "log_line").withColumn("line", line)).select("log_id", "n_blocks", "n_warnings")


_GAPS = """g AS (SELECT log_id, lag(ts) OVER (PARTITION BY log_id ORDER BY line_no) AS from_ts, ts AS to_ts FROM log_line), gaps AS (SELECT *, (epoch_us(to_ts) - epoch_us(from_ts)) / 60e6 AS gap_minutes FROM g WHERE from_ts IS NOT NULL)"""


@query("WITH " + _GAPS + " SELECT log_id, from_ts, to_ts, round(gap_minutes, 6) AS gap_minutes FROM gaps WHERE gap_minutes > 300")
def silent_periods(s, d):
    return logs.silent_periods(view(s, d, "log_line"), 300).select("log_id", "from_ts", "to_ts", R("gap_minutes"))


@query(
    "WITH " + _GAPS + " SELECT l.log_id, count(gap_minutes) AS n_gaps, round(coalesce(max(gap_minutes), 0), 6) AS max_gap_minutes, coalesce(max(gap_minutes), 0) <= 2000 AS has_progress FROM (SELECT DISTINCT log_id FROM log_line) l LEFT JOIN (SELECT * FROM gaps WHERE gap_minutes > 300) g USING (log_id) GROUP BY l.log_id"
)
def log_progress(s, d):
    return logs.progress(view(s, d, "log_line"), 300, 2000).select("log_id", "n_gaps", R("max_gap_minutes"), "has_progress")


@query("""WITH x AS (SELECT log_id, line_no, string_agg(line, chr(10)) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s, min(CASE WHEN contains(line, 'in task 7') THEN line_no END) OVER (PARTITION BY log_id) AS f FROM log_line) SELECT log_id, line_no, md5(s) AS snippet_md5 FROM x WHERE line_no = f
UNION ALL SELECT log_id, NULL, md5(substr(string_agg(line, chr(10) ORDER BY line_no), 1, 500)) FROM log_line GROUP BY log_id HAVING NOT bool_or(contains(line, 'in task 7'))""")
def snippets(s, d):
    return logs.snippets(view(s, d, "log_line"), "in task 7").select("log_id", "line_no", F.md5("snippet").alias("snippet_md5"))


@query(
    "SELECT log_id, line_no, line FROM log_line WHERE regexp_matches(line, '(?i)error|exception|failed|fatal') QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY line_no DESC) <= 5"
)
def last_error_lines(s, d):
    return logs.last_error_lines(view(s, d, "log_line"))


@query("""WITH x AS (SELECT log_id, line_no, CAST(regexp_extract(line, 'Stage (\\d+) finished', 1) AS BIGINT) AS stage, CAST(regexp_extract(line, 'finished in (\\d+) ms', 1) AS DOUBLE) / 1000 AS duration_s FROM log_line WHERE regexp_matches(line, 'Stage \\d+ finished'))
SELECT log_id, stage, 'completed' AS status, round(arg_max(duration_s, line_no), 6) AS duration_s FROM x GROUP BY ALL""")
def stage_times(s, d):
    return logs.stage_times(view(s, d, "log_line")).select("log_id", "stage", "status", R("duration_s"))


@query(
    "SELECT log_id, min(regexp_extract(line, 'application_\\d+_\\d+', 0)) AS app FROM log_line WHERE contains(line, 'application_') GROUP BY log_id"
)
def application_ids(s, d):
    return view(s, d, "log_line").groupBy("log_id").agg(F.min(text.application_id(F.col("line"))).alias("app")).filter("app IS NOT NULL")


@query(
    """SELECT sql_id, 'output' AS role, regexp_extract(content, 'TABLE (\\S+)', 1) AS table_name FROM sql_text UNION ALL SELECT sql_id, 'input', regexp_extract(content, 'FROM (\\S+)', 1) FROM sql_text UNION ALL SELECT sql_id, 'input', regexp_extract(content, 'JOIN (\\S+)', 1) FROM sql_text"""
)
def sql_tables(s, d):
    x = view(s, d, "sql_text")
    out = [
        x.select(
            "sql_id",
            F.lit(r).alias("role"),
            F.explode(f(F.col("content"))).alias("table_name")
        ) for r, f in (("output", text.sql_targets), ("input", text.sql_sources))
    ]
    return out[0].unionByName(out[1])


@query("""SELECT sql_id, regexp_extract(content, 'TABLE (\\S+)', 1) AS target, 1::BIGINT AS n FROM sql_text""")
def embedded_sql(s, d):
    code = F.concat(F.lit('class A { val q = """'), F.col("content"), F.lit('""" ; val x = "not it" }'))
    found = view(s, d, "sql_text").select("sql_id", text.embedded_sql(F.lit(".scala"), code).alias("q"))
    return found.select("sql_id", F.element_at(text.sql_targets(F.get("q", F.lit(0))), 1).alias("target"), F.size("q").cast("long").alias("n"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://([^/]+)', 1), ''), '') AS host FROM pages""")
def page_hosts(s, d):
    return view(s, d, "pages").select("page_id", F.coalesce(text.found(F.col("url"), r"^https?://([^/]+)"), F.lit("")).alias("host"))


@query(
    """SELECT table_name, CASE WHEN starts_with(table_name, 'hdfs:') THEN 'HDFS' WHEN starts_with(table_name, 'mysql:') THEN 'MYSQL' ELSE 'HIVE' END AS table_type, array_to_string(string_split(concat('x.', table_name), '.')[-2:], '.') AS short FROM (SELECT DISTINCT CASE WHEN length(table_name) % 3 = 0 THEN concat('mysql:', table_name) ELSE table_name END AS table_name FROM task_use)"""
)
def table_types(s, d):
    t = view(s, d, "task_use").select(
        F.when(F.length("table_name") % 3 == 0, F.concat(F.lit("mysql:"), F.col("table_name"))).otherwise(F.col("table_name")).alias("table_name")
    ).distinct()
    return t.select(
        "table_name",
        text.table_type(F.col("table_name")).alias("table_type"),
        text.short_table(F.concat(F.lit("x."), F.col("table_name"))).alias("short")
    )


@query(
    """SELECT event_id, CAST(floor(mb) AS BIGINT) AS mb, CASE WHEN mb < 1024 THEN concat(CAST(mb AS BIGINT), 'm') WHEN mb % 1024 = 0 THEN concat(CAST(mb // 1024 AS BIGINT), 'g') ELSE concat(CAST(mb AS BIGINT), 'm') END AS shown FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 64 * 1024 WHEN 1 THEN event_id % 5000 ELSE event_id % 9000 END AS mb FROM events)"""
)
def memory_sizes(s, d):
    e = F.col("event_id")
    written = F.when(e % 3 == 0, F.concat((e % 64).cast("string"), F.lit("g"))).when(
        e % 3 == 1,
        F.concat((e % 5000).cast("string"), F.lit("M"))
    ).otherwise((e % 9000).cast("string"))
    mb = text.memory_mb(written)
    return view(s, d, "events").select("event_id", mb.alias("mb"), text.memory_text_whole(mb).alias("shown"))


_RULES = [
    ("PYTHON", "AUTO_FIXABLE", 1, 1, "oom", r"outofmemoryerror.*heap", "more memory"),
    ("PYTHON", "KNOWN_NEEDS_LLM", 2, 2, "task", r"exception in task \d+", "look"),
    ("SHELL", "AUTO_FIXABLE", 1, 1, "stage", r"stage [12]\d? finished", "fine"),
    ("SHELL", "KNOWN_NEEDS_LLM", 2, 1, "info", r"^info", "fine"),
    ("SPARK", "KNOWN_NEEDS_LLM", 2, 1, "frame", r"worker\.java:\d*7\)", "frame"),
]


@query("""WITH l AS (SELECT concat(log_id, '-', line_no) AS log_id, line, CASE WHEN line LIKE 'ERROR%' THEN 'PYTHON' WHEN line LIKE 'INFO%' THEN 'SHELL' ELSE 'SPARK' END AS task_type FROM log_line)
SELECT log_id, task_type, CASE WHEN task_type = 'PYTHON' THEN 'oom' WHEN regexp_matches(lower(line), 'stage [12]\\d? finished') THEN 'stage' WHEN task_type = 'SHELL' THEN 'info' WHEN regexp_matches(lower(line), 'worker\\.java:\\d*7\\)') THEN 'frame' ELSE 'UNKNOWN' END AS error_type FROM l""")
def rule_matches(s, d):
    line = F.col("line")
    kind = F.when(line.startswith("ERROR"), "PYTHON").when(line.startswith("INFO"), "SHELL").otherwise("SPARK")
    texts = view(s, d, "log_line").select(F.concat_ws("-", "log_id", "line_no").alias("log_id"), kind.alias("task_type"), line.alias("text"))
    rules = s.createDataFrame(_RULES, "task_type string, category string, category_rank int, ord int, error_type string, pattern string, hint string")
    return match.match_rules(texts, rules).select("log_id", "task_type", "error_type")


@query(
    """SELECT concat(log_id, '-', line_no) AS log_id, CASE WHEN line LIKE '%Job aborted%' THEN 'k2' WHEN line LIKE '%stage%' THEN 'k3' END AS knowledge_id FROM log_line WHERE line <> ''"""
)
def knowledge_matches(s, d):
    texts = view(s, d, "log_line").filter("line != ''").select(
        F.concat_ws("-", "log_id", "line_no").alias("log_id"),
        F.lit("SPARK").alias("task_type"),
        F.col("line").alias("text")
    )
    known = s.createDataFrame(
        [
            ("k1", "SPARK", "Job", False, 1, "confirmed"),
            ("k2", "SPARK", "Job aborted", True, 2, "confirmed"),
            ("k3", "SPARK", "stage", False, 3, "confirmed"),
            ("k4", "SPARK", "INFO", True, 0, "pending")
        ],
        "id string, task_type string, pattern string, has_fix boolean, ord int, status string"
    )
    return match.match_knowledge(texts, known)


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents WHERE text IS NOT NULL")
def document_lines(s, d):
    return logs.lines(view(s, d, "documents"), "doc_id").groupBy(F.col("log_id").alias("doc_id")).agg(F.max("line_no").cast("long").alias("n_lines"))
