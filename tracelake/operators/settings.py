"""Lines of logs that set something, by the type of the task that wrote the log."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Task types, and what a line of theirs that sets something matches, without regard to case.
SETTINGS = {
    ("SPARK", "SPARKSQL", "SPARK_APP"): (
        r"--conf\s+spark\.\w+\s*=",
        r"spark-submit.*--conf",
        r"--executor-memory\s+\S+",
        r"--driver-memory\s+\S+",
        r"--num-executors\s+\S+",
        r"--executor-cores\s+\S+",
        r'"(executorMemory|driverMemory|executorCores|numExecutors|driverCores|mainClass|appName)"\s*:',
        r"spark\.\w+\s*[=:]\s*\S+",
    ),
    ("FLINK", "FLINK_SQL"): (
        r"flink\s+run\s+",
        r"-p\s+\d+",
        r"-yjm\s+\S+",
        r"-ytm\s+\S+",
        r"-yn\s+\d+",
        r"-ys\s+\d+",
        r"flink\.parallelism\s*[=:]",
        r"pipeline\.name\s*[=:]",
        r"taskmanager\.[\w.]+\s*[=:]",
        r"state\.backend\s*[=:]",
        r"checkpoint\.[\w.]+\s*[=:]",
        r'"(jobManagerMemory|taskManagerMemory|parallelism|slots|mainClass)"\s*:',
    ),
    ("DATAX", "DATAX_SYNC"): (
        r'"(speed|bytes|records|channel|job|content|reader|writer|connection|jdbcUrl|querySql|path|fileName|fileFormat)"\s*:',
        r"--job\s+",
        r"--mode\s+",
    ),
    ("SHELL", "PYTHON", "PYTHON_SCRIPT"): (
        r"^(python|bash|sh)\s+",
        r"^\./\S+",
        r"^/[\w/]+\.\w+",
        r"--\w+\s+\S+",
        r"-\w\s+\S+",
        r"^import\s+\w+",
        r"^from\s+\w+\s+import",
        r"^(export|set)\s+\w+=",
    ),
    ("HTTP", "API", "REST"): (
        r"https?://[^\s'\"]+",
        r'"(url|endpoint|timeout|retry|method|headers)"\s*:',
    ),
    ("SQL", "HIVE", "HIVESQL"): (
        r"^(SELECT|INSERT|CREATE|UPDATE|DELETE|DROP)\s+",
        r"SET\s+hive\.\w+\s*=",
        r'"(database|table)"\s*:',
    ),
    ("SUB_PROCESS", "SUBPROCESS"): (
        r'"(workflowDefinitionCode|workflowDefinitionName|definitionCode|definitionName|subWorkflowInstanceId|processInstanceId|workerGroup|tenantCode)"\s*:',
    ),
    ("DEPENDENT", "DEPENDENT_TASK"): (
        r'"(dependence|definitionCode|taskDefinitionCode|relation|projectId|depTaskCode|status|dateValue|cycle|dayHours)"\s*:',
    ),
}
# The same for all other types.
OTHERS = (
    r"--conf\s+spark\.\w+\s*=",
    r'"(executorMemory|driverMemory|speed|channel|url|timeout)"\s*:',
    r"flink\.parallelism\s*[=:]",
    r"taskmanager\.memory\.\w+\s*[=:]",
    r"^(python|bash)\s+",
    r"^import\s+\w+",
    r"hadoop\.\w+\s*=",
    r"yarn\.\w+\s*=",
)
# Lines of code and of errors, which set nothing; case counts.
CODE = (
    r"spark\.scheduler\.",
    r"spark\.executor\.\w+Executor",
    r"spark\.deploy\.",
    r"spark\.sql\.\w+\$",
    r"spark\.rdd\.",
    r"flink\.runtime\.",
    r"flink\.execution\.",
    r"\.scala:\d+",
    r"\.\w+\(",
    r"\b(Spark|Flink)?Exception\b",
    r"\bError\b",
)


def _any(patterns: tuple[str, ...], flags: str = "") -> str:
    return flags + "|".join(patterns)


def sets_something(line: Column, task_type: Column) -> Column:
    """Whether a trimmed line is a setting of a task of this type, written in any case; a null type is like an unknown one."""
    kind = F.upper(F.coalesce(task_type, F.lit("")))
    by_type = reduce(lambda out, x: out.when(kind.isin(*x[0]), line.rlike(_any(x[1], "(?i)"))), SETTINGS.items(), F)
    return by_type.otherwise(line.rlike(_any(OTHERS, "(?i)"))) & ~line.rlike(_any(CODE))


def setting_lines(log_lines: DataFrame) -> DataFrame:
    """(log_id, line_no, line) of log lines (log_id, task_type, line_no, line) that set something, trimmed."""
    line = F.btrim(F.col("line"), F.lit(" \t\r\n\x0b\x0c"))
    return log_lines.select("log_id", "line_no", line.alias("line"), "task_type").filter(sets_something(F.col("line"), F.col("task_type"))).select("log_id", "line_no", "line")
