"""Logs as lines (log_id, line_no, line): error blocks, their ranking and summary, gaps, and events.

Blocks and gaps depend on the lines before; they are found in ranges of a log, with what a range takes over from the
ones before it, so that a giant log is the work of many tasks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import every, found
from . import segments

# What starts an error block, tested without regard to case on the trimmed line.
STARTS = (
    r"\bERROR\b",
    r"\bFATAL\b",
    r"\bException\b",
    r"^FetchFailedException",
    r"^Traceback \(most recent call last\)",
    r"^java\.[a-z]+\.[A-Z]",
    r"^org\.[a-z]+\.[A-Z]",
    r"^com\.[a-z]+\.[A-Z]",
    r"^\w+Error:",
    r"^\w+Exception:",
    r"^[A-Z][a-zA-Z]+Error",
    r"/bin/bash:.*error",
    r"\bPermission denied\b",
    r"\bConnection refused\b",
    r"\bno space left\b",
    r"\bCannot connect\b",
    r"\bFailed to connect\b",
    r"\bCommunications link failure\b",
    r"\bDuplicate entry.*for key\b",
    r"\bAccess denied for user\b",
    r"\bTable.*doesn'?t exist\b",
    r"\bORA-\d+",
    r"\bContainer killed\b",
    r"\bPath.*does not exist\b",
    r"process has exited.*exitStatusCode\s*[=:]\s*[1-9]",
    r"\bexitStatusCode\s*[=:]\s*[1-9]",
    r"\bSend task execute status: FAILURE\b",
    r"\bFinalize task instance\b.*FAILURE",
    r"^ls:.*No such file",
    r"^cat:.*No such file",
    r"^rm:.*No such file",
    r"^mkdir:.*cannot create",
    r"^cp:.*cannot",
    r"^mv:.*cannot",
    r"^chmod:.*cannot",
    r"^chown:.*cannot",
    r"^grep:.*",
    r"^find:.*",
    r"^sed:.*",
    r"^awk:.*",
    r"^curl:.*",
    r"^wget:.*",
    r"^ssh:.*",
    r"^scp:.*",
    r"^tar:.*",
    r"^unzip:.*",
    r"^python:.*",
    r"^pip:.*",
    r"^docker:.*",
    r"^kubectl:.*",
    r"\bNo such file or directory\b",
    r"\bcommand not found\b",
    r"\bsyntax error\b",
    r"\bsegmentation fault\b",
    r"\bcore dumped\b",
)
# What continues an open block; case counts. Lines are trimmed, so nothing here starts with white space.
CONTINUES = (
    r"Caused by:",
    r"^The last packet",
    r"^During handling",
    r"^Duplicate entry",
    r"^Access denied",
    r"^Table.*doesn",
    r"^Connection refused",
    r"^Timeout",
    r"^Invalid",
    r"^Out of range",
    r"^Data truncation",
    r"^com\.mysql",
    r"^java\.\w+",
    r"^org\.\w+",
    r"^[a-z]+\.[a-z]+\.[A-Z]",
    r"^[A-Z][a-zA-Z]+Error:",
    r"^[A-Z][a-zA-Z]+Exception",
)
# What begins a line that continues a block of fewer than 30 lines.
SOFT = ("at", "Caused", "File", "import", "The", "More", "Error", "Exception")
# Warnings that matter.
CRITICAL = (
    r"GC overhead limit exceeded",
    r"GC pause.*exceeds",
    r"Shuffle fetch failed.*retry",
    r"Executor lost.*heartbeat",
    r"Memory pressure detected",
    r"Low memory",
    r"Slow task detected",
    r"Skew detected",
    r"Connection.*retry",
    r"Retrying.*connection",
    r"Retry.*attempt.*failed",
    r"Remote shuffle server unavailable",
    r"Container memory limit exceeded",
    r"BlockManager heartbeat timeout",
    r"Checkpoint timeout",
    r"Task execution timeout",
    r"Task timeout",
    r"execution time exceeds",
    r"Heartbeat timeout",
    r"Job stuck",
)
# Weights of words in a block; the greatest counts.
WEIGHTS = {
    "OutOfMemoryError": 10,
    "GC overhead limit exceeded": 10,
    "Memory limit exceeded": 9,
    "Container killed": 9,
    "Executor lost": 8,
    "heartbeat timeout": 8,
    "FetchFailedException": 8,
    "SparkException: Job aborted": 7,
    "Job aborted": 7,
    "Task failed": 6,
    "Stage failed": 6,
    "Communications link failure": 6,
    "Access denied": 5,
    "Permission denied": 5,
    "Duplicate entry": 5,
    "process has exited": 5,
    "exitStatusCode": 5,
    "Exception": 4,
    "Error": 3,
    "FATAL": 2,
    "ERROR": 1,
}


def lines(logs: DataFrame, id_col: str = "log_id", text_col: str = "text") -> DataFrame:
    """One row for each line of a log, from 1."""
    return logs.select(
        F.col(id_col).alias("log_id"),
        F.posexplode(F.split(text_col, "\n")).alias("p", "line")
    ).select("log_id", (F.col("p") + 1).alias("line_no"), "line")


def trimmed(c: Column) -> Column:
    """Without white space at its ends, tabs included."""
    return F.btrim(c, F.lit(" \t\r\n\x0b\x0c"))


def _any(patterns: tuple[str, ...], flags: str = "") -> str:
    """One pattern for all. Those that begin the text, or a word, are tested only there and not at each place."""
    groups: dict[str, list[str]] = {"^": [], r"\b": [], "": []}
    for p in patterns:
        # A bar outside brackets would leave the rest without its anchor.
        head = next(h for h in groups if p.startswith(h) and not (h and "|" in p))
        groups[head].append(f"(?:{p[len(head):]})")
    return flags + "|".join(f"{head}(?:{'|'.join(ps)})" for head, ps in groups.items() if ps)


def error_blocks(log_lines: DataFrame, most: int = 30, per_range: int = 4096) -> DataFrame:
    """(log_id, pos, n_lines, block): error blocks in order.

    A start line opens a block; a blank line closes it. Stack frames, exception lines and causes extend it, and so do
    lines with a soft prefix while it has fewer than `most` lines. Another line closes it if it has fewer; else that line is
    skipped, and the block goes on with exception lines and causes up to the next start or blank line. A cause opens a
    block only where none is open. Logs are read in ranges of per_range lines, each by any task (see segments).
    """
    t = trimmed(F.col("line"))
    caused, starts = t.startswith("Caused by:"), t.rlike(_any(STARTS, "(?i)"))
    kind = F.when(t == "", segments.BLANK).when(~caused & starts, segments.START).when(caused & starts, segments.LATE)
    kind = kind.when(t.rlike(_any(CONTINUES)), segments.HARD).when(t.rlike(f"^(?:{'|'.join(SOFT)})"), segments.SOFT).otherwise(segments.OTHER)
    marked = log_lines.select("log_id", "line_no", kind.alias("kind"), "line")
    marked = marked.withColumn("line", F.when(~F.col("kind").isin(segments.BLANK, segments.OTHER), F.col("line")))
    kept = segments.block_lines(marked, most, per_range)
    blocks = kept.groupBy("log_id", "pos").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return blocks.select(
        "log_id",
        "pos",
        F.size("_l").cast("long").alias("n_lines"),
        F.array_join(F.transform("_l", lambda x: x.line), "\n").alias("block")
    )


def critical_warnings(log_lines: DataFrame) -> DataFrame:
    return log_lines.filter(F.col("line").rlike(_any(CRITICAL, "(?i)"))).select("log_id", "line_no", trimmed(F.col("line")).alias("line"))


def exception_type(block: Column) -> Column:
    return F.coalesce(
        found(block, r"(?:java|org|com)\.[a-z]+\.[A-Z][a-zA-Z]*(?:Exception|Error)?", 0),
        found(block, r"[A-Z][a-zA-Z]+Error", 0),
        F.lower(found(block, r"(?i)(Permission denied|Connection refused|No such file|command not found)")),
        F.lower(found(block, r"(?i)(process has exited|exitStatusCode)")),
        F.lit("unknown"),
    )


def first_of_type(blocks: DataFrame) -> DataFrame:
    """The first block of each exception type of a log."""
    typed = blocks.withColumn("exception_type", exception_type(F.col("block")))
    return typed.withColumn("_r", F.row_number().over(Window.partitionBy("log_id", "exception_type").orderBy("pos"))).filter("_r = 1").drop("_r")


def score(block: Column) -> Column:
    low = F.lower(block)
    return F.greatest(*(F.when(low.contains(w.lower()), k).otherwise(0) for w, k in WEIGHTS.items()))


def ranked(blocks: DataFrame) -> DataFrame:
    """blocks with score and rank: the greatest weight first, equals in their order."""
    scored = blocks.withColumn("score", score(F.col("block")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("score"), "pos")))


def summary(block: Column, most: int = 10) -> Column:
    """The first line, all causes, and exception lines up to `most` lines; a short block as it is."""
    parts = F.split(trimmed(block), "\n")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: trimmed(x))
    keep = F.filter(rest, lambda x: x.startswith("Caused by:") | x.rlike(r"^[a-z]+\.[a-z]+\.[A-Z]|^[A-Z][a-zA-Z]+Error"))
    cut = F.filter(keep, lambda x, i: x.startswith("Caused by:") | (i < most - 1))
    return F.when(F.size(parts) <= most, block).otherwise(F.array_join(F.concat(F.slice(parts, 1, 1), cut), "\n"))


def root_cause(block: Column) -> Column:
    causes = every(block, r"Caused by:\s*(.+)")
    return F.trim(F.when(F.size(causes) > 0, F.element_at(causes, -1)).otherwise(F.split(trimmed(block), "\n")[0]))


def error_summary(log_lines: DataFrame, most: int = 10) -> DataFrame:
    """By log: numbers of blocks and of exception types, the root cause and the summaries of the top blocks."""
    blocks = error_blocks(log_lines)
    n = blocks.groupBy("log_id").agg(F.count("*").alias("n_blocks"))
    top = ranked(first_of_type(blocks))
    by = top.groupBy("log_id").agg(
        F.count("*").alias("n_unique"),
        F.max(F.when(F.col("rank") == 1, root_cause(F.col("block")))).alias("root_cause"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", summary(F.col("block")).alias("text"))))).alias("_t"),
    )
    warn = critical_warnings(log_lines).groupBy("log_id").agg(F.count("*").alias("n_warnings"))
    ids = log_lines.select("log_id").distinct()
    out = ids.join(n, "log_id", "left").join(by, "log_id", "left").join(warn, "log_id", "left").fillna(0, ["n_blocks", "n_unique", "n_warnings"]).fillna("", ["root_cause"])
    return out.select("log_id", "n_blocks", "n_unique", "n_warnings", "root_cause", F.transform("_t", lambda x: x.text).alias("blocks"))


def timestamp_of(line: Column) -> Column:
    t = trimmed(line)
    text = F.regexp_replace(found(t, r"^(\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2})"), "/", "-")
    return F.try_to_timestamp(F.regexp_replace(text, r"\s+", " "), F.lit("yyyy-MM-dd HH:mm:ss"))


def silent_periods(stamped: DataFrame, minutes: float = 5.0, per_range: int = 4096) -> DataFrame:
    """(log_id, from_ts, to_ts, gap_minutes): consecutive times ts of a log (in order of line_no) over minutes apart.

    Within ranges of per_range lines from line to line; between ranges from the last time of one to the first of the next.
    """
    part = F.floor(F.col("line_no") / per_range).alias("part")
    timed = stamped.filter("ts IS NOT NULL").select("log_id", part, "line_no", "ts")
    inside = timed.withColumn("from_ts", F.lag("ts").over(Window.partitionBy("log_id", "part").orderBy("line_no")))
    ends = timed.groupBy("log_id", "part").agg(F.min_by("ts", "line_no").alias("ts"), F.max_by("ts", "line_no").alias("last"))
    between = ends.withColumn("from_ts", F.lag("last").over(Window.partitionBy("log_id").orderBy("part")))
    gaps = inside.select("log_id", "from_ts", "ts").unionByName(between.select("log_id", "from_ts", "ts"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("from_ts").cast("timestamp"))) / 60e6
    return gaps.withColumn("gap_minutes", gap).filter(F.col("gap_minutes") > minutes).select(
        "log_id",
        "from_ts",
        F.col("ts").alias("to_ts"),
        "gap_minutes"
    )


def progress(stamped: DataFrame, minutes: float = 5.0, stuck: float = 10.0) -> DataFrame:
    """By log: number of gaps, the longest, and whether the log went on."""
    gaps = silent_periods(stamped, minutes).groupBy("log_id").agg(F.count("*").alias("n_gaps"), F.max("gap_minutes").alias("max_gap_minutes"))
    out = stamped.select("log_id").distinct().join(gaps, "log_id", "left").fillna(0, ["n_gaps"]).fillna(0.0, ["max_gap_minutes"])
    return out.withColumn("has_progress", F.col("max_gap_minutes") <= stuck)


def snippets(log_lines: DataFrame, pattern: str, around: int = 5, head: int = 500) -> DataFrame:
    """(log_id, line_no, snippet): the lines round the first match in each log; without a match, line_no is null and the
    snippet is the log's first `head` characters."""
    first = log_lines.filter(F.col("line").rlike(pattern)).groupBy("log_id").agg(F.min("line_no").alias("_f"))
    at, f = F.col("line_no"), F.col("_f")
    near = log_lines.join(first, "log_id", "left").filter(F.when(f.isNull(), at <= head + 1).otherwise(at.between(f - around, f + around)))
    by = near.groupBy("log_id").agg(F.min("_f").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: x.line), "\n")
    return by.select("log_id", "line_no", F.when(F.col("line_no").isNull(), F.substring(joined, 1, head)).otherwise(joined).alias("snippet"))


def last_error_lines(log_lines: DataFrame, n: int = 5, pattern: str = r"(?i)error|exception|failed|fatal") -> DataFrame:
    at = Window.partitionBy("log_id").orderBy(F.desc("line_no"))
    hits = log_lines.filter(F.col("line").rlike(pattern)).withColumn("_r", F.row_number().over(at)).filter(F.col("_r") <= n)
    return hits.select("log_id", "line_no", "line")


def config_lines(
    log_lines: DataFrame,
    pattern: str = r"(?i)(spark\.[\w.]+\s*[=:]|--(conf|executor|driver|num-executors|master|queue|class)\b)"
) -> DataFrame:
    code = r"(?i)^\s*at\s|exception|caused by|^\s*import\s"
    return log_lines.filter(F.col("line").rlike(pattern) & ~F.col("line").rlike(code))


def current_config(lines_with_config: DataFrame) -> DataFrame:
    """The last value of each known setting of a log."""
    keys = {
        "driver_memory": r"spark\.driver\.memory\s*[=:]\s*(\w+)",
        "executor_memory": r"spark\.executor\.memory\s*[=:]\s*(\w+)",
        "executor_cores": r"spark\.executor\.cores\s*[=:]\s*(\d+)",
        "executor_instances": r"spark\.executor\.instances\s*[=:]\s*(\d+)"
    }
    values = {k: found(F.col("line"), p) for k, p in keys.items()}
    return lines_with_config.groupBy("log_id").agg(*(F.max_by(v, F.when(v.isNotNull(), F.col("line_no"))).alias(k) for k, v in values.items()))


def stage_times(log_lines: DataFrame) -> DataFrame:
    """(log_id, stage, status, duration_s, reason): of each field the last line that speaks of the stage."""
    line = F.col("line")
    stage = F.coalesce(found(line, r"(?i)Stage\s+(\d+)\s+(?:started|completed|finished|failed)")).cast("long")
    n, unit = found(line, r"(?i)(?:duration\s*[=:]\s*|finished\s+in\s+)(\d+)\s*(?:ms|s|min|h)?").cast("double"), F.lower(
        F.regexp_extract(line, r"(?i)(?:duration\s*[=:]\s*|finished\s+in\s+)\d+\s*(ms|s|min|h)?", 1)
    )
    seconds = n * F.when(unit == "min", 60.0).when(unit == "h", 3600.0).when(unit == "s", 1.0).otherwise(0.001)
    status = F.when(line.rlike(r"(?i)Stage\s+\d+\s+failed"), "failed").when(
        line.rlike(r"(?i)Stage\s+\d+\s+(completed|finished)"),
        "completed"
    ).otherwise("running")
    rows = log_lines.select(
        "log_id",
        "line_no",
        stage.alias("stage"),
        status.alias("status"),
        seconds.alias("duration_s"),
        F.substring(found(line, r"(?i)Stage\s+\d+\s+failed\s*[,:]\s*(.*)"), 1, 100).alias("reason")
    ).filter("stage IS NOT NULL")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    return rows.groupBy("log_id", "stage").agg(last("status"), last("duration_s"), last("reason"))


def executor_events(log_lines: DataFrame) -> DataFrame:
    """(log_id, line_no, event, executor, reason) of executors added, removed, lost or timed out."""
    line = F.col("line")
    kinds = {
        "added": r"(?i)Added executor\s+(\d+)",
        "removed": r"(?i)Removed executor\s+(\d+)",
        "lost": r"(?i)Executor\s+(\d+)\s+lost",
        "heartbeat_timeout": r"(?i)Executor\s+(\d+)\s+heartbeat timeout"
    }
    events = F.filter(
        F.array(*(F.struct(F.lit(k).alias("event"), found(line, p).cast("long").alias("executor")) for k, p in kinds.items())),
        lambda x: x.executor.isNotNull()
    )
    reason = F.trim(found(line, r"(?i)Removed executor\s+\d+[\s:]+(?:reason\s*[=:]\s*)?([^)]*)"))
    return log_lines.select("log_id", "line_no", F.explode(events).alias("e"), reason.alias("reason")).select(
        "log_id",
        "line_no",
        "e.event",
        "e.executor",
        F.when(F.col("e.event") == "removed", F.col("reason")).alias("reason")
    )


def jvm_exceptions(blocks: DataFrame) -> DataFrame:
    """Type, message, root cause and frames of blocks with a JVM exception."""
    block = F.col("block")
    frames = F.arrays_zip(
        every(block, r"at\s+([\w.$]+)\.[\w$<>]+\("),
        every(block, r"at\s+[\w.$]+\.([\w$<>]+)\("),
        every(block, r"at\s+[\w.$]+\.[\w$<>]+\(([^:)]*)"),
        every(block, r"at\s+[\w.$]+\.[\w$<>]+\([^:)]*:?(\d*)")
    )
    named = F.transform(
        frames,
        lambda x: F.struct(x["0"].alias("class"), x["1"].alias("method"), x["2"].alias("file"), x["3"].try_cast("int").alias("line"))
    )
    kind = found(block, r"((?:[a-z]\w*\.)+[A-Z]\w*(?:Exception|Error))")
    return blocks.filter(kind.isNotNull()).select(
        "log_id",
        "pos",
        kind.alias("type"),
        F.trim(found(block, r"(?:[a-z]\w*\.)+[A-Z]\w*(?:Exception|Error):\s*([^\n]*)")).alias("message"),
        root_cause(block).alias("root_cause"),
        named.alias("frames")
    )


def python_tracebacks(blocks: DataFrame) -> DataFrame:
    """Type, message, frames and deepest frame of the Python traceback in each text (log_id, pos, block).

    Segmentation starts a block of its own at the exception's line, so this takes whole logs as blocks.
    """
    block = F.col("block")
    frames = F.transform(
        F.arrays_zip(every(block, r'File "([^"]+)"'), every(block, r'File "[^"]+", line (\d+)'), every(block, r'File "[^"]+", line \d+, in (\S+)')),
        lambda x: F.struct(x["0"].alias("file"), x["1"].try_cast("int").alias("line"), x["2"].alias("function"))
    )
    kind = found(block, r"(?m)^\s*([A-Z]\w*(?:Error|Exception))\b")
    return blocks.filter(block.contains("Traceback") & kind.isNotNull()).select(
        "log_id",
        "pos",
        kind.alias("type"),
        F.trim(found(block, r"(?m)^\s*[A-Z]\w*(?:Error|Exception):\s*(.*)$")).alias("message"),
        frames.alias("frames"),
        F.when(F.size(frames) > 0, F.element_at(frames, -1)).alias("deepest")
    )


def shell_errors(log_lines: DataFrame) -> DataFrame:
    line = F.col("line")
    kind = F.when(line.contains("syntax error"), "syntax_error").when(line.contains("command not found"), "command_not_found").when(line.contains("Permission denied"), "permission_denied").when(line.contains("No such file"), "file_not_found")
    return log_lines.filter(kind.isNotNull()).select(
        "log_id",
        "line_no",
        found(line, r"line (\d+):").cast("int").alias("script_line"),
        kind.alias("type"),
        F.substring(line, 1, 200).alias("message")
    )


def executor_containers(containers: DataFrame, n: int = 3) -> DataFrame:
    """The first n executor containers (app, container) of each application."""
    k = found(F.col("container"), r"_(\d+)$").cast("long")
    rank = F.row_number().over(Window.partitionBy("app").orderBy("_k", "container"))
    return containers.withColumn("_k", k).filter("_k > 1").withColumn("_r", rank).filter(F.col("_r") <= n).drop("_k", "_r")


def useful(log_lines: DataFrame) -> DataFrame:
    """(log_id, is_useful): whether a log gives a setting, an error block, an application id or anything to measure."""
    line = F.col("line")
    fact = line.rlike(r"application_\d+|app-\d+-\d+") | line.rlike(r"(?i)spark\.[\w.]+\s*[=:]") | line.rlike(r"(?i)(bytes|records|rows)\D{0,20}[1-9]")
    by = log_lines.groupBy("log_id").agg(F.bool_or(fact).alias("_f"))
    blocks = error_blocks(log_lines).select("log_id").distinct().withColumn("_b", F.lit(True))
    return by.join(blocks, "log_id", "left").select("log_id", (F.col("_f") | F.coalesce("_b", F.lit(False))).alias("is_useful"))
