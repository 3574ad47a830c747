"""Matching logs with rule catalogues and knowledge."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import literals


def checked_catalogue(patterns: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) rules; valid holds the patterns that the regex engine accepts (see valid_patterns)."""
    ok = valid.select("pattern").distinct()
    return patterns.join(ok, "pattern", "left_semi"), patterns.join(ok, "pattern", "left_anti")


def valid_patterns(patterns: DataFrame) -> DataFrame:
    """The distinct patterns that compile, tested by the executors' own regex engine."""
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern")).isNotNull()
    return patterns.select("pattern").distinct().filter(compiles)


#: How large a catalogue is sent to every task, and over how many parts logs are dealt where it is larger.
MOST_RULES, MOST_BYTES, SPREAD = 5_000, 8 << 20, 64
#: Up to so many rules are tested on every log of their task type without an index.
FEW = 16


def _pairs(logs: DataFrame, rules: DataFrame, most_rules: int, few: int, fold: bool, literal_of) -> DataFrame:
    """logs joined with those rules of their task type that can match.

    A catalogue whose rows and bytes are counted as few is sent to every task: as it is, or with an index over its
    literals. Of a larger one each of SPREAD parts of the logs meets a copy, so that a task type, of which there are few,
    isn't a hot key.
    """
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    if n <= few:
        return logs.join(F.broadcast(rules), "task_type")
    if n <= most_rules and size <= MOST_BYTES:
        return literals.rule_pairs(logs, rules, fold, literal_of)
    dealt = rules.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return logs.withColumn("_part", F.pmod(F.xxhash64("log_id"), F.lit(SPREAD)).cast("int")).join(dealt, ["task_type", "_part"]).drop("_part")


def match_rules(logs: DataFrame, patterns: DataFrame, most_rules: int = MOST_RULES, few: int = FEW) -> DataFrame:
    """Each log's first rule of its task type: by category_rank, then ord; without any, UNKNOWN.

    logs(log_id, task_type, text), patterns(task_type, category, category_rank, ord, error_type, pattern, hint).
    Matching disregards case, and the dot matches line ends. Of more than `few` rules only those are tested whose
    literals occur in the log (see literals).
    """
    rules = patterns.select("task_type", "category", "category_rank", "ord", "error_type", "pattern", "hint")
    pairs = _pairs(logs, rules, most_rules, few, True, literals.required).filter(F.expr("text rlike concat('(?is)', pattern)"))
    hit = F.struct("category_rank", "ord", "category", "error_type", "pattern", "hint")
    first = pairs.groupBy("log_id").agg(F.min(hit).alias("m")).select("log_id", "m.category", "m.error_type", "m.pattern", "m.hint")
    out = logs.select("log_id", "task_type").join(first, "log_id", "left")
    return out.withColumn("error_type", F.coalesce("error_type", F.lit("UNKNOWN"))).withColumn("category", F.coalesce("category", F.lit("UNKNOWN")))


def match_knowledge(logs: DataFrame, knowledge: DataFrame, most_rules: int = MOST_RULES, few: int = FEW) -> DataFrame:
    """Each log's confirmed knowledge entry whose pattern it contains: one with a fix first, then by ord.

    knowledge(id, task_type, pattern, has_fix, ord, status); logs(log_id, task_type, text). The patterns are literals, so
    that the index alone finds them.
    """
    known = knowledge.filter("status = 'confirmed' AND pattern IS NOT NULL").select("task_type", "id", "pattern", "has_fix", "ord")
    pairs = _pairs(logs, known, most_rules, few, False, lambda x: {x} if x else None).filter(F.col("text").contains(F.col("pattern")))
    best = pairs.groupBy("log_id").agg(F.min_by("id", F.struct((~F.col("has_fix")).alias("a"), "ord")).alias("knowledge_id"))
    return logs.select("log_id").join(best, "log_id", "left")


def services(hosts: DataFrame) -> DataFrame:
    """(ip, port, hostname, service) of host rows whose services are `name (port), name (port)`."""
    octets = F.transform(F.split("ip", r"\."), lambda x: x.try_cast("int"))
    valid = (F.size(octets) == 4) & F.forall(octets, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    pairs = F.arrays_zip(
        F.regexp_extract_all("services", F.lit(r"([\w -]+?)\s*\((\d+)\)"), F.lit(1)),
        F.regexp_extract_all("services", F.lit(r"([\w -]+?)\s*\((\d+)\)"), F.lit(2))
    )
    out = hosts.filter(valid).select("ip", "hostname", F.explode(pairs).alias("p"))
    return out.select("ip", F.col("p")["1"].cast("int").alias("port"), "hostname", F.trim(F.col("p")["0"]).alias("service"))


def lookup_services(targets: DataFrame, hosts: DataFrame) -> DataFrame:
    """targets(ip, port) with hostname and service, null where unknown."""
    return targets.join(services(hosts), ["ip", "port"], "left")


def best_class_file(classes: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each class(project, class): its own project's before another's, by the order of candidates.

    classes has candidates (array of path suffixes); files(project, path, suffix), suffix being the path from the
    package root, so that the join is on equality.
    """
    wanted = classes.select("project", "class", F.posexplode("candidates").alias("ord", "suffix"))
    hits = wanted.join(files.select(F.col("project").alias("in_project"), "path", "suffix"), "suffix")
    order = Window.partitionBy("project", "class").orderBy((F.col("project") != F.col("in_project")).cast("int"), "ord", "in_project", "path")
    first = hits.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    return first.select("project", "class", "path", "in_project", (F.col("project") != F.col("in_project")).alias("cross_project"))
