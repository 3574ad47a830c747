"""Column expressions for SQL text, paths, names, sizes and facts in logs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that can follow FROM or JOIN without naming a table, and what makes a string SQL.
SQL_WORDS = ("select", "where", "set", "values", "table", "on", "using", "lateral", "unnest", "dual")
_NAME = r"[`\w]+(?:\.[`\w]+)*"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _tables(text: Column, pattern: str) -> Column:
    names = F.transform(every(text, pattern), lambda x: F.replace(x, F.lit("`"), F.lit("")))
    return F.array_distinct(F.filter(names, lambda x: ~F.lower(x).isin(*SQL_WORDS) & (F.length(x) > 1)))


def sql_targets(text: Column) -> Column:
    """Tables that INSERT OVERWRITE or INSERT INTO writes."""
    return _tables(text, rf"(?i)\binsert\s+(?:overwrite|into)\s+(?:table\s+)?({_NAME})")


def sql_sources(text: Column) -> Column:
    """Tables after FROM or JOIN, without the names of common table expressions."""
    ctes = F.transform(every(text, r"(?i)(?:\bwith|,)\s+(\w+)\s+as\s*\("), lambda x: F.lower(x))
    tables = _tables(text, rf"(?i)\b(?:from|join)\s+({_NAME})")
    return F.filter(tables, lambda x: ~F.array_contains(ctes, F.lower(x)))


def embedded_sql(extension: Column, content: Column) -> Column:
    """SQL strings in source text by file extension: a .sql file is one; strings count if they hold a SQL verb."""
    triple = r'(?s)"""(.*?)"""'
    strings = (
        F.when(extension == ".sql", F.array(content))
        .when(extension.isin(".java", ".scala"), F.concat(every(content, triple), every(F.regexp_replace(content, triple, ""), r'"((?:[^"\\\n]|\\.)+)"')))
        .when(extension == ".py", F.concat(every(content, triple), every(content, r"(?s)'''(.*?)'''"), every(F.regexp_replace(F.regexp_replace(content, triple, ""), r"(?s)'''.*?'''", ""), r"'((?:[^'\\\n]|\\.)+)'")))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.filter(strings, lambda x: x.rlike(r"(?i)\b(select|insert|update|delete|create)\b"))


def table_type(name: Column) -> Column:
    return F.when(name.startswith("hdfs:"), "HDFS").when(name.startswith("mysql:"), "MYSQL").otherwise("HIVE")


def sync_tables(params: Column) -> Column:
    """Struct (inputs, outputs) of the tables in a data-sync job definition (JSON)."""
    end = "struct<name: string, parameter: struct<path: string, database: string, `table`: string, connection: array<struct<`table`: array<string>>>>>"
    job = F.from_json(params, f"job struct<content: array<struct<reader: {end}, writer: {end}>>>")

    def named(x: Column) -> Column:
        p, kind = x["parameter"], F.lower(F.coalesce(x["name"], F.lit("")))
        # A table is a name, or a list of which the first counts.
        table = F.coalesce(F.get_json_object(p["table"], "$[0]"), p["table"], F.get(F.get(p["connection"], F.lit(0))["table"], F.lit(0)))
        hdfs = F.concat(F.lit("hdfs:"), F.regexp_replace(p["path"], r"/dt=[^/]*", ""))
        hive = F.when(p["database"].isNotNull() & p["table"].isNotNull(), F.concat_ws(".", p["database"], table))
        mysql = F.when(table.isNotNull(), F.concat(F.lit("mysql:"), F.concat_ws(".", p["database"], table)))
        return F.when(kind.contains("hdfs"), hdfs).when(kind.contains("hive"), hive).when(kind.contains("mysql"), mysql)

    ends = lambda side: F.array_distinct(
        F.filter(F.transform(F.coalesce(job["job"]["content"], F.array()), lambda c: named(c[side])), lambda x: x.isNotNull())
    )
    return F.struct(ends("reader").alias("inputs"), ends("writer").alias("outputs"))


def main_class(params: Column) -> Column:
    return F.coalesce(F.get_json_object(params, "$.mainClass"), found(params, r"--class\s+([\w.$]+)"))


def jar_project(jar: Column) -> Column:
    """A jar's name without folder, version and suffixes."""
    name = F.regexp_replace(F.element_at(F.split(jar, "/"), -1), r"(-jar-with-dependencies)?\.jar$", "")
    return F.regexp_replace(name, r"-\d+(\.\d+)*([-.](SNAPSHOT|RELEASE))?$", "")


def class_paths(name: Column) -> Column:
    """Files in which a class may be, in order of preference."""
    base = F.replace(F.regexp_replace(name, r"\$.*$", ""), F.lit("."), F.lit("/"))
    return F.array(*(F.concat(base, F.lit(x)) for x in (".scala", ".java", ".py")))


def short_table(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


# The forms in which storage paths carry a date.
_DATES = (r"(?:dt|date|day)=(\d{4}-\d{2}-\d{2})", r"(?:dt|date|day)=(\d{8})", r"/(\d{8})(?:/|$)", r"/(\d{4}-\d{2}-\d{2})(?:/|$)")


def partition_date(path: Column) -> Column:
    """The date in a path, or null."""
    slashed = F.concat_ws(
        "-",
        found(path, r"/(\d{4})/\d{2}/\d{2}(?:/|$)"),
        found(path, r"/\d{4}/(\d{2})/\d{2}(?:/|$)"),
        found(path, r"/\d{4}/\d{2}/(\d{2})(?:/|$)")
    )
    text = F.coalesce(*(found(path, p) for p in _DATES), F.nullif(slashed, F.lit("")))
    return F.when(
        F.length(text) == 8,
        F.try_to_timestamp(text, F.lit("yyyyMMdd"))
    ).otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def partition_key(path: Column) -> Column:
    return found(path, r"(dt|date|day)=")


def partition_base(path: Column) -> Column:
    """The path up to its date; the path itself without one."""
    return F.regexp_replace(path, r"/(?:(?:dt|date|day)=)?(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{4}/\d{2}/\d{2})(?:/.*)?$", "")


def partition_path(base: Column, day: Column, key: str = "dt") -> Column:
    """The path of a day's partition under base."""
    return F.concat(F.rtrim(base, F.lit("/")), F.lit(f"/{key}="), day.cast("string"), F.lit("/"))


def memory_mb(text: Column) -> Column:
    """A memory string such as 4g, 512m, 2048k or 1t in whole MB; a bare number counts as MB."""
    n, unit = F.regexp_extract(F.lower(text), r"^\s*([\d.]+)", 1).try_cast("double"), F.regexp_extract(F.lower(text), r"^\s*[\d.]+\s*([kmgt]?)", 1)
    return F.floor(n * F.when(unit == "k", 1 / 1024).when(unit == "g", 1024).when(unit == "t", 1048576).otherwise(1)).cast("long")


def memory_text(mb: Column) -> Column:
    """Whole GB as `4g`, halves and the like as `1.5g`, less than one as `512m`."""
    gb = mb / 1024
    return F.when(mb < 1024, F.concat(mb.cast("string"), F.lit("m"))).when(
        mb % 1024 == 0,
        F.concat((mb / 1024).cast("long").cast("string"), F.lit("g"))
    ).otherwise(F.format_string("%.1fg", F.round(gb, 1)))


def memory_text_whole(mb: Column) -> Column:
    """Whole GB as `4g`, anything else in MB."""
    return F.when(
        (mb >= 1024) & (mb % 1024 == 0),
        F.concat((mb / 1024).cast("long").cast("string"), F.lit("g"))
    ).otherwise(F.concat(mb.cast("string"), F.lit("m")))


def application_id(text: Column) -> Column:
    return F.coalesce(found(text, r"application_\d+_\d+", 0), found(text, r"app-\d+-\d+", 0), found(text, r"application_\d+", 0))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"


def targets(text: Column) -> Column:
    """Distinct hdfs addresses, valid ip:port and host:port pairs with ports up to 65535."""
    ports = lambda xs: F.filter(xs, lambda x: F.substring_index(x, ":", -1).cast("int").between(1, 65535))
    ip = ports(every(text, rf"(?<![\d.])((?:{_OCTET}\.){{3}}{_OCTET}:\d{{1,5}})(?!\d)"))
    host = ports(every(text, r"(?<![\w./-])([A-Za-z][\w-]*(?:\.[\w-]+)*:\d{2,5})(?!\d)"))
    return F.array_distinct(F.concat(every(text, r"(hdfs://[\w.:/=-]+)"), ip, host))


def storage_paths(text: Column, n: int = 5) -> Column:
    """The n longest distinct storage paths of a text; of equals in alphabetical order."""
    local = F.filter(every(text, r"(/(?:user|data|warehouse|hive|tmp|output)[/\w.=-]+)"), lambda x: F.length(x) > 10)
    paths = F.array_distinct(F.concat(every(text, r"(oss://[\w.-]+(?:/[\w./=-]+)?)"), every(text, r"(hdfs://[\w.:-]*(?:/[\w./=-]+)?)"), local))
    return F.transform(
        F.slice(F.array_sort(F.transform(paths, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("path")))), 1, n),
        lambda x: x.path
    )


# Errors by class; all others are of class EXECUTION.
ERROR_CLASSES = {
    "oom_executor": "RESOURCE",
    "oom_driver": "RESOURCE",
    "oom_driver_direct": "RESOURCE",
    "container_killed": "RESOURCE",
    "executor_lost": "RESOURCE",
    "class_not_found": "CONFIG",
    "no_class_def": "CONFIG",
    "shuffle_failed": "NETWORK",
    "connection_refused": "NETWORK",
    "hdfs_not_found": "DATA",
    "schema_mismatch": "DATA",
    "syntax_error": "EXECUTION",
    "broadcast_timeout": "EXECUTION",
    "stage_failed": "EXECUTION",
    "command_not_found": "EXECUTION",
}


def error_class(error_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in ERROR_CLASSES.items() for x in kv))
    return F.coalesce(F.element_at(table, error_type), F.lit("EXECUTION"))


def excerpt(text: Column, n: int = 100) -> Column:
    """text without time stamp and level, cut to n characters."""
    bare = F.regexp_replace(text, r"^\s*[\[(]?\d{2,4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}[.,]?\d*[\])]?\s*", "")
    return F.substring(F.trim(F.regexp_replace(bare, r"^\s*\[?(?:ERROR|FATAL|WARN|WARNING|INFO|DEBUG)\]?:?\s*", "")), 1, n)


def generalised(short: Column) -> Column:
    """A pattern from an excerpt: numbers and the first path become wild; a long one, or one with a backslash, stays."""
    wild = F.regexp_replace(short, r"\d+", r"\\d+")
    path = found(wild, r"(/[\w./\\+-]+)")
    wild = F.when(path.isNotNull(), F.replace(wild, path, F.lit(".*"))).otherwise(wild)
    return F.when((F.length(short) > 50) | short.contains("\\"), short).otherwise(wild)


def log_excerpt(text: Column, blocks: Column, strategy: str = "smart", cap: int = 100_000) -> Column:
    """What is shown of a long log: error blocks and a head, or head and tail; input up to cap characters."""
    t = F.substring(text, 1, cap)
    ends = F.when(F.length(t) > 5000, F.concat(F.substring(t, 1, 2000), F.lit("\n...\n"), F.right(t, F.lit(3000)))).otherwise(t)
    if strategy == "full":
        return t
    if strategy == "head_tail":
        return ends
    shown = F.array_join(blocks, "\n\n")
    if strategy == "errors_only":
        return shown
    return F.when(F.size(blocks) > 0, F.concat(shown, F.lit("\n\n"), F.substring(t, 1, 500))).otherwise(ends)


def combined(*texts: Column) -> Column:
    """Texts that aren't empty, in order."""
    return F.concat_ws("\n", *(F.nullif(t, F.lit("")) for t in texts))


def diagnostics_tail(text: Column) -> Column:
    """The first 300 characters after the mark of YARN's diagnostics, if they speak of a killed container or of memory."""
    tail = F.regexp_extract(text, r"(?s)\[YARN Diagnostics\]\n(.+)", 1)
    return F.when(tail.contains("Container killed") | F.lower(tail).contains("memory"), F.substring(tail, 1, 300))


def database_type(text: Column) -> Column:
    out = F
    for name in ("mysql", "oracle", "postgresql", "sqlserver", "hive", "hdfs", "mongodb", "clickhouse"):
        out = out.when(F.lower(text).contains(name), name)
    return out.otherwise(None)


def broadcast_mb(text: Column) -> Column:
    """The largest broadcast that a log speaks of, in MB."""
    sizes = F.arrays_zip(
        every(text, r"(?i)(?:broadcast size|Build relation size)\s*[=:]\s*([\d.]+)").alias("n"),
        F.transform(
            every(text, r"(?i)(?:broadcast size|Build relation size)\s*[=:]\s*[\d.]+\s*((?:MB|KB|GB|bytes)?)"),
            lambda x: F.lower(x)
        ).alias("unit")
    )
    mb = F.transform(
        sizes,
        lambda x: x["n"].cast("double") * F.when(x["unit"] == "kb", 1 / 1024).when(x["unit"] == "mb", 1).when(x["unit"] == "gb", 1024).otherwise(1 / 1048576)
    )
    return F.coalesce(F.array_max(mb), F.lit(0.0))


def join_strategies(text: Column) -> Column:
    """Strategies that a log names as chosen; else those whose operators it shows."""
    chosen = every(text, r"(?i)Choosing join strategy\s*[=:]\s*(BroadcastHashJoin|SortMergeJoin|ShuffleHashJoin|CartesianProduct)")
    seen = F.filter(F.array(*(F.when(text.contains(x), x) for x in ("BroadcastHashJoin", "SortMergeJoin"))), lambda x: x.isNotNull())
    return F.when(F.size(chosen) > 0, chosen).otherwise(seen)


def plan_counts(text: Column) -> Column:
    """How often a physical plan has each join operator, and its distinct scans."""
    joins = [F.regexp_count(text, F.lit(x)).alias(x) for x in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin")]
    return F.struct(*joins, F.array_distinct(every(text, r"(?:Scan|FileScan) (?:parquet|orc|hive|csv|json)?\s*([\w.]+)")).alias("scans"))


def class_project(name: Column, owner: str) -> Column:
    """The part of a class's package after the owner's prefix, such as `a` in `com.owner.a.b.C`; null elsewhere."""
    return found(name, rf"^{owner.replace('.', chr(92) + '.')}\.([\w-]+)\.")


def sync_facts(text: Column) -> Column:
    """Facts of a data-sync log: database type, JDBC host and port, hashed user, job id, channels, reader and writer."""
    user = found(text, r"(?i)user(?:name)?\s*[=:]\s*[\"']?([\w@.-]+)")
    return F.struct(
        database_type(text).alias("database"),
        found(text, r"jdbc:\w+:(?:thin:@)?//([\w.-]+(?::\d+)?)").alias("host"),
        F.when(user.isNotNull(), F.sha2(user, 256)).alias("user_sha256"),
        found(text, r"(?i)job[_ ]?id\s*[=:]\s*\[?(\d+)").cast("long").alias("job_id"),
        found(text, r"(?i)channels?\s*[=:\"]+\s*(\d+)").cast("int").alias("channels"),
        F.lower(found(text, r"(?i)\b(\w+reader)\b")).alias("reader"),
        F.lower(found(text, r"(?i)\b(\w+writer)\b")).alias("writer"),
    )


def dependency_facts(text: Column) -> Column:
    """What the log of a dependent task says it waits for: definition, project and task codes, cycle and date value."""
    plain = F.replace(text, F.lit('\\"'), F.lit('"'))
    codes = lambda key: F.array_distinct(every(plain, rf'"{key}"\s*:\s*"?(\d+)'))
    return F.struct(
        codes("definitionCode").alias("definitions"),
        codes("projectCode").alias("projects"),
        codes("depTaskCode").alias("tasks"),
        found(plain, r'"cycle"\s*:\s*"(\w+)"').alias("cycle"),
        found(plain, r'"dateValue"\s*:\s*"(\w+)"').alias("date_value")
    )


def executor_sequence(container: Column) -> Column:
    """The number of a container; 1 is the master, greater ones are executors."""
    return found(container, r"_(\d+)$").cast("long")
