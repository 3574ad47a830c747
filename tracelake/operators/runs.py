"""Runs and resources: instance metrics, task distributions, event logs, baselines and size suggestions."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import memory_mb, memory_text_whole
from . import quantiles
from .graph import checkpointed


def by_state(
    instances: DataFrame,
    start: str,
    end: str,
    state: str | None = None,
    project: str | None = None,
    workflow: str | None = None
) -> DataFrame:
    """Instances that started in [start, end); every filter reaches the scan."""
    out = instances.filter((F.col("start_time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("start_time") < F.lit(end).cast("timestamp_ntz")))
    for c, v in (("state", state), ("project", project), ("workflow", workflow)):
        out = out.filter(F.col(c) == v) if v is not None else out
    return out


def day_range(day: str, today: Column | None = None) -> tuple[Column, Column]:
    """[start, end) of `today`, `yesterday` or a date."""
    base = today if today is not None else F.current_date()
    start = base if day == "today" else F.date_sub(base, 1) if day == "yesterday" else F.lit(day).cast("date")
    return start.cast("timestamp_ntz"), F.date_add(start, 1).cast("timestamp_ntz")


def newest(instances: DataFrame, n: int = 50) -> DataFrame:
    return instances.orderBy(F.desc("start_time"), "id").limit(n)


def daily_workflow_metrics(instances: DataFrame) -> DataFrame:
    """By project and day: instances by state, success rate, and durations."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    out = instances.groupBy("project", F.to_date("start_time").alias("day")).agg(
        F.count("*").alias("total"),
        is_("SUCCESS").alias("success"),
        is_("FAILURE").alias("failure"),
        is_("RUNNING").alias("running"),
        F.avg("duration").alias("avg_duration"),
        F.max("duration").alias("max_duration"),
        F.min("duration").alias("min_duration")
    )
    return out.withColumn(
        "other",
        F.col("total") - F.col("success") - F.col("failure") - F.col("running")
    ).withColumn("success_rate", F.col("success") / F.col("total")).withColumn("failure_rate", F.col("failure") / F.col("total"))


def daily_type_metrics(instances: DataFrame) -> DataFrame:
    return instances.groupBy("project", F.to_date("start_time").alias("day"), "task_type").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "FAILURE").alias("failure"),
        F.avg("duration").alias("avg_duration")
    )


def daily_error_metrics(failures: DataFrame, examples: int = 3) -> DataFrame:
    """By project, day and error type: how many failures (id, project, start_time, error_type, task_type), of which task
    types, and the first few ids. Each task keeps a key's first few ids only, so a day's failures aren't sorted in one."""
    key = ["project", "day", "error_type"]
    rows = failures.withColumn("day", F.to_date("start_time"))
    by = rows.groupBy(*key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("task_type")).alias("task_types"))
    ranked = rows.select(*key, "id").withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).filter(F.col("_r") <= examples)
    first = ranked.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.array_sort(F.collect_list("id")).alias("examples"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key))
    return by.join(first, same).select(*key, "n", "task_types", "examples")


def range_report(instances: DataFrame, first: str, last: str) -> DataFrame:
    """The daily metrics of a range of days, in one aggregation."""
    day = F.to_date("start_time")
    return daily_workflow_metrics(instances.filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))))


def state_counts(instances: DataFrame) -> DataFrame:
    return instances.groupBy(F.to_date("start_time").alias("day")).agg(
        *(F.count_if(F.col("state") == s).alias(s.lower()) for s in ("SUCCESS", "FAILURE", "RUNNING"))
    )


_DISTRIBUTION = ("app", "stage", "n_tasks", "median_duration", "max_duration", "median_input", "skew_ratio", "is_skewed", "n_stragglers", "n_input_skewed")


def task_distribution(tasks: DataFrame, ratio: float = 3.0, most: int = 10_000) -> DataFrame:
    """By (app, stage): median of the durations over 0, the longest, their ratio, whether skewed, and stragglers.

    A task is a straggler over `ratio` medians, and skewed by input over `ratio` upper medians of all inputs. The
    durations of a stage of up to `most` tasks meet in one buffer; larger stages go by counts of their values (see
    distribution), which gather nothing. Tasks without app or stage are left out.
    """
    stage = ["app", "stage"]
    tasks = tasks.select(*stage, "duration", "input_bytes").filter("app IS NOT NULL AND stage IS NOT NULL")
    large = checkpointed(tasks.groupBy(*stage).count().filter(F.col("count") > most).drop("count"))
    n = large.count()
    if not n:
        return _of_few(tasks, ratio)
    sent = F.broadcast(large) if n <= 20_000 else large
    by_counts = distribution(checkpointed(task_counts(tasks.join(sent, stage, "left_semi"))), ratio)
    return _of_few(tasks.join(sent, stage, "left_anti"), ratio).unionByName(by_counts)


def _of_few(tasks: DataFrame, ratio: float) -> DataFrame:
    """task_distribution() of stages whose tasks are few enough for a buffer and a window."""
    stats = tasks.groupBy("app", "stage").agg(
        F.count("*").alias("n_tasks"),
        F.median(F.when(F.col("duration") > 0, F.col("duration"))).alias("median_duration"),
        F.max("duration").alias("max_duration")
    )
    # The upper median by counts of the distinct inputs, so that no task gathers all inputs of a stage.
    inputs = tasks.filter("input_bytes IS NOT NULL").groupBy("app", "stage", "input_bytes").agg(F.count("*").alias("_n"))
    inputs = inputs.withColumn("_upto", F.sum("_n").over(Window.partitionBy("app", "stage").orderBy("input_bytes")))
    upper = inputs.join(stats.select("app", "stage", "n_tasks"), ["app", "stage"]).filter(F.col("_upto") > F.floor(F.col("n_tasks") / 2))
    stats = stats.join(upper.groupBy("app", "stage").agg(F.min("input_bytes").alias("median_input")), ["app", "stage"], "left")
    skew = F.try_divide(F.col("max_duration"), F.col("median_duration"))
    stats = stats.withColumn("skew_ratio", skew).withColumn("is_skewed", F.coalesce(skew > ratio, F.lit(False)))
    flags = tasks.join(stats.select("app", "stage", "median_duration", "median_input"), ["app", "stage"])
    slow = flags.groupBy("app", "stage").agg(
        F.count_if(F.col("duration") > ratio * F.col("median_duration")).alias("n_stragglers"),
        F.count_if((F.col("input_bytes") > ratio * F.col("median_input")) & (F.col("median_input") > 0)).alias("n_input_skewed")
    )
    return stats.join(slow, ["app", "stage"]).select(*_DISTRIBUTION)


def task_counts(tasks: DataFrame) -> DataFrame:
    """(app, stage, kind, value, n): how often a stage's tasks have each duration and each input; counts of several days
    merge by quantiles.merged_counts()."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("duration", "duration"), ("input", "input_bytes"))))
    rows = tasks.select("app", "stage", F.explode(kinds).alias("k")).select("app", "stage", "k.kind", "k.value")
    return quantiles.value_counts(rows, ["app", "stage", "kind"], "value")


def distribution(counts: DataFrame, ratio: float = 3.0) -> DataFrame:
    """task_distribution() from the counts of task_counts(), which should be a table or a checkpoint, as they are read again."""
    stage = ["app", "stage"]
    is_duration, value, n = F.col("kind") == "duration", F.col("value"), F.col("n")
    stats = counts.groupBy(*stage).agg(
        F.sum(F.when(is_duration, n)).alias("n_tasks"),
        F.sum(F.when(is_duration & (value > 0), n)).alias("_n"),
        F.max(F.when(is_duration, value)).alias("max_duration")
    )
    stats = checkpointed(stats)
    few = stats.count() <= 100_000
    places = {"low": ("duration", F.floor((F.col("_n") - 1) / 2)), "high": ("duration", F.floor(F.col("_n") / 2)), "input": ("input", F.floor(F.col("n_tasks") / 2))}
    wanted = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, (kind, rank) in places.items()))
    ranks = stats.select(*stage, F.explode(wanted).alias("w")).select(*stage, "w.*").filter("rank IS NOT NULL")
    found = quantiles.at_ranks(counts.filter(~is_duration | (value > 0)), [*stage, "kind"], ranks, few)
    at = {x: F.max(F.when(F.col("name") == x, value)) for x in places}
    medians = found.groupBy(*stage).agg(((at["low"] + at["high"]) / 2).alias("median_duration"), at["input"].alias("median_input"))
    stats = stats.drop("_n").join(medians, stage, "left")
    skew = F.try_divide(F.col("max_duration"), F.col("median_duration"))
    stats = checkpointed(stats.withColumn("skew_ratio", skew).withColumn("is_skewed", F.coalesce(skew > ratio, F.lit(False))))
    over = F.when(is_duration, value > ratio * F.col("median_duration")).otherwise((value > ratio * F.col("median_input")) & (F.col("median_input") > 0))
    # Counts, not tasks, meet the medians.
    limits = stats.select(*stage, "median_duration", "median_input")
    flags = counts.join(F.broadcast(limits) if few else limits, stage).filter(over)
    slow = flags.groupBy(*stage).agg(F.sum(F.when(is_duration, n)).alias("n_stragglers"), F.sum(F.when(~is_duration, n)).alias("n_input_skewed"))
    out = stats.join(slow, stage, "left").fillna(0, ["n_stragglers", "n_input_skewed"])
    return out.select(*_DISTRIBUTION)


def app_skew(distribution: DataFrame) -> DataFrame:
    by = distribution.groupBy("app").agg(
        F.bool_or("is_skewed").alias("is_skewed"),
        F.max("skew_ratio").alias("max_ratio"),
        F.sum("n_input_skewed").alias("n_input_skewed")
    )
    return by.withColumn("advice", F.when(~F.col("is_skewed"), "none").when(F.col("n_input_skewed") > 0, "salting").otherwise("parallelism"))


def newest_baseline(history: DataFrame, n: int = 5, metrics: tuple[str, ...] = ("input_bytes_mb", "peak_memory_mb")) -> DataFrame:
    """Mean and population deviation of the positive values of a workflow's newest n successes; null for one value."""
    rank = F.row_number().over(Window.partitionBy("workflow").orderBy(F.desc("day"), F.desc("run")))
    rows = history.filter("success").withColumn("_r", rank).filter(F.col("_r") <= n)
    cols = []
    for m in metrics:
        v = F.when(F.col(m) > 0, F.col(m))
        cols += [F.avg(v).alias(f"avg_{m}"), F.when(F.count(v) > 1, F.stddev_pop(v)).alias(f"std_{m}")]
    return rows.groupBy("workflow").agg(F.count("*").alias("n"), *cols)


def predict_memory(history: DataFrame, current_mb: Column) -> DataFrame:
    """Executor memory and instances for an input of current_mb, from a workflow's successes; LOW without 3 of them.

    Memory follows mean peak over mean input; from 5 successes on the slope between the lower and the upper half by
    input, if inputs differ. 30 % are added, and the past minimum of the setting is the floor. Instances take 2048 MB of
    shuffle each, between the past minimum and twice the past maximum.
    """
    ok = history.filter("success AND peak_memory_mb > 0")
    by = Window.partitionBy("workflow")
    ok = ok.withColumn("_n", F.count("*").over(by)).withColumn("_r", F.row_number().over(by.orderBy("input_bytes_mb", "run")))
    low = F.col("_r") <= F.floor(F.col("_n") / 2)
    half = lambda c, side: F.avg(F.when(low if side else ~low, F.col(c)))
    agg = ok.groupBy("workflow").agg(
        F.count("*").alias("n"), F.avg("input_bytes_mb").alias("_d"), F.avg("peak_memory_mb").alias("_p"),
        half("input_bytes_mb", True).alias("_d0"), half("input_bytes_mb", False).alias("_d1"), half("peak_memory_mb", True).alias("_p0"), half("peak_memory_mb", False).alias("_p1"),
        F.avg(F.col("shuffle_read_mb") + F.col("shuffle_write_mb")).alias("_s"),
        F.min("executor_memory_mb").alias("_m"), F.min("executor_instances").alias("_i0"), F.max("executor_instances").alias("_i1"),
    )
    slope = F.when(
        (F.col("n") >= 5) & (F.col("_d1") > F.col("_d0")),
        (F.col("_p1") - F.col("_p0")) / (F.col("_d1") - F.col("_d0"))
    ).otherwise(F.try_divide("_p", "_d"))
    enough = (F.col("n") >= 3) & (F.col("_d") > 0)
    peak = current_mb * slope
    memory = F.greatest((peak * 1.3).cast("long"), F.col("_m"))
    wanted = F.greatest(F.lit(2), (current_mb * F.col("_s") / F.col("_d") / 2048).cast("long"))
    instances = F.greatest(F.col("_i0"), F.least(wanted, F.col("_i1") * 2))
    when = lambda x: F.when(enough, x)
    return agg.select(
        "workflow",
        "n",
        F.when(~enough, "LOW").when(F.col("n") >= 5, "HIGH").otherwise("MEDIUM").alias("confidence"),
        when(slope).alias("memory_per_data"),
        when(memory).alias("executor_memory_mb"),
        when(instances).alias("executor_instances")
    )


#: The settings that a balanced configuration may take.
MEMORIES, INSTANCES = (512, 1024, 2048, 3072, 4096, 6144, 8192), range(2, 21)


def balanced_config(needs: DataFrame, target: float = 1.5) -> DataFrame:
    """The memory and instances nearest to `target` times shuffle_mb, in moderation; 4 GB executors if none fits.

    The grid has 133 rows whatever the input, so it is broadcast.
    """
    spark = needs.sparkSession
    grid = spark.createDataFrame(
        [(m, n) for m in MEMORIES for n in INSTANCES if not (m <= 512 and n > 8 or m >= 6144 and n < 4)],
        "mem long, inst long"
    )
    keys = needs.select("key", "shuffle_mb").distinct()
    ratio = F.col("mem") * F.col("inst") / F.col("shuffle_mb")
    tried = keys.filter("shuffle_mb > 0").crossJoin(F.broadcast(grid)).withColumn("ratio", ratio).filter(F.col("ratio").between(1.5, 2.5))
    score = F.abs(F.col("ratio") - target) - F.when(F.col("inst").between(4, 12), 0.1).otherwise(0.0)
    best = tried.groupBy("key", "shuffle_mb").agg(F.min(F.struct(F.round(score, 9).alias("s"), "mem", "inst")).alias("b"))
    out = keys.join(best, ["key", "shuffle_mb"], "left")
    fallback = F.greatest(F.lit(2), F.least(F.lit(20), (F.col("shuffle_mb") * target / 4096).cast("long") + 1))
    return out.select(
        "key",
        "shuffle_mb",
        F.coalesce("b.mem", F.lit(4096)).cast("long").alias("executor_memory_mb"),
        F.coalesce("b.inst", fallback).cast("long").alias("executor_instances")
    )


def memory_use_status(total_mb: Column, shuffle_mb: Column) -> Column:
    r = F.try_divide(total_mb, shuffle_mb)
    return F.when(r < 1, "risky").when(r < 1.5, "need_increase").when(r <= 2, "optimal").when(r <= 3, "slightly_over").when(r.isNotNull(), "over_configured").otherwise("unknown")


def executor_memory(
    current_mb: Column,
    predicted_mb: Column,
    spilled_mb: Column,
    peak_mb: Column,
    shuffle_mb: Column,
    slots: Column,
    cap: int = 16384
) -> Column:
    """Struct (mb, method): a prediction first, then spill, peak, shuffle, else twice the present; at most cap."""
    made = [
        ("history_prediction", predicted_mb, predicted_mb.isNotNull()),
        ("oom_spill", current_mb + spilled_mb, spilled_mb > 0),
        ("peak_memory", (peak_mb * 1.3).cast("long"), peak_mb > 0),
        ("shuffle_based", F.greatest((shuffle_mb / slots * 1.5).cast("long"), current_mb * 2), (shuffle_mb > 0) & (slots > 0)),
    ]
    out = F
    for method, mb, holds in made:
        out = out.when(holds, F.struct(F.least(mb.cast("long"), F.lit(cap)).alias("mb"), F.lit(method).alias("method")))
    return out.otherwise(F.struct(F.least((current_mb * 2).cast("long"), F.lit(cap)).alias("mb"), F.lit("fallback_double").alias("method")))


def driver_memory(current_mb: Column, spilled_mb: Column, cap: int = 8192) -> Column:
    return F.least(F.when(spilled_mb > 0, current_mb + spilled_mb).otherwise(current_mb * 2), F.lit(cap))


def executor_instances(current: Column, shuffle_mb: Column, cap: int = 100) -> Column:
    """More executors for the shuffle, at most twice the present; null if no more are needed."""
    wanted = F.least(F.greatest(F.lit(2), F.floor(shuffle_mb / 2048)), current * 2, F.lit(cap)).cast("long")
    return F.when((shuffle_mb >= 2048) & (wanted > current), wanted)


def timeout_metrics(tasks: DataFrame, history: DataFrame) -> DataFrame:
    """By workflow: retries, the slowest task and the longest wait, with flags against history.

    tasks(workflow, name, ord, retry_count, retry_interval, queue_wait, data_size, duration), history(workflow,
    avg_duration, avg_data).
    """
    first = lambda c: F.max_by("name", F.struct(c, (-F.col("ord")).alias("o")))
    by = tasks.groupBy("workflow").agg(
        F.max("retry_count").alias("max_retry"),
        first("retry_count").alias("retry_task"),
        F.max(F.col("retry_count") * F.col("retry_interval")).alias("retry_time"),
        F.max("duration").alias("max_duration"),
        first("duration").alias("slowest_task"),
        F.max("queue_wait").alias("max_wait"),
        F.sum("data_size").alias("data_size")
    )
    out = by.join(history, "workflow", "left")
    return out.withColumn(
        "is_slow",
        F.coalesce(F.col("max_duration") > 2 * F.col("avg_duration"), F.lit(False))
    ).withColumn("is_data_spike", F.coalesce(F.col("data_size") > 5 * F.col("avg_data"), F.lit(False)))


def timeout_class(m: DataFrame) -> DataFrame:
    """The first of nine rules that holds: timeout_type, category and confidence.

    Columns: util (percent, the greater of memory and cores), containers, queue_used (percent), apps, max_retry, max_wait,
    avg_wait, max_duration, avg_duration, is_data_spike, upstream_delay.
    """
    c = F.col
    times = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    advised, known = "RESOURCE_SUGGESTED", "KNOWN_NEEDS_LLM"
    rules = [
        ("cluster_overloaded", advised, 0.85, c("util") > 85),
        ("cluster_overloaded", advised, 0.8, c("containers") > 100),
        ("queue_congested", advised, 0.8, c("queue_used") > 90),
        ("queue_congested", advised, 0.75, c("apps") > 10),
        ("task_retry_timeout", known, 0.9, c("max_retry") >= 3),
        ("queue_wait_long", known, 0.85, (c("max_wait") > 300) & (times("max_wait", "avg_wait") > 2)),
        ("task_execution_slow", known, 0.8, times("max_duration", "avg_duration") > 3),
        ("data_volume_spike", known, 0.7, c("is_data_spike")),
        ("upstream_delay", known, 0.65, c("upstream_delay")),
    ]
    row = lambda name, category, confidence: F.struct(
        F.lit(name).alias("timeout_type"),
        F.lit(category).alias("category"),
        F.lit(confidence).alias("confidence")
    )
    out = F
    for name, category, confidence, holds in rules:
        out = out.when(holds, row(name, category, confidence))
    return m.withColumn("_t", out.otherwise(row("unknown", "UNKNOWN", 0.0))).select(*m.columns, "_t.*")


def cluster_status(snapshots: DataFrame) -> DataFrame:
    """Utilisation and health in percent, and the reasons for calling a cluster overloaded."""
    pct = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0)), 2)
    out = snapshots.withColumn("memory_pct", pct("used_memory_mb", "total_memory_mb")).withColumn("vcore_pct", pct("used_vcores", "total_vcores"))
    out = out.withColumn(
        "health_pct",
        F.round(F.coalesce(F.try_divide(F.col("active_nodes") * 100.0, F.col("active_nodes") + F.col("unhealthy_nodes")), F.lit(0.0)), 2)
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("memory_pct") > 85, "memory"),
            F.when(F.col("vcore_pct") > 85, "vcores"),
            F.when(F.col("pending_containers") > 100, "containers"),
            F.when(F.col("health_pct") < 80, "nodes")
        )
    )
    return out.withColumn("reasons", reasons).withColumn("is_overloaded", F.size("reasons") > 0)


def is_safe(memory_pct: Column, apps: Column) -> Column:
    """Whether a cluster may take more work."""
    return ~((memory_pct > 80) | (apps > 10))


# Event logs: one JSON event a line, read by sources.event_log().


def _of(events: DataFrame, name: str) -> DataFrame:
    return events.filter(F.col("Event") == f"SparkListener{name}")


def _one(rows: DataFrame, keys: list[str], which) -> DataFrame:
    """One row for each of keys: that with the least or the greatest line number (which: F.min_by or F.max_by)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(which(F.struct(*rest), "line_no").alias("_r")).select(
        *keys,
        *(F.col("_r")[c].alias(c) for c in rest if c != "line_no")
    )


def event_totals(events: DataFrame) -> DataFrame:
    """Bytes by app over finished tasks, and counts of events."""
    m = F.col("`Task Metrics`")
    is_task = F.col("Event") == "SparkListenerTaskEnd"
    part = lambda x: F.sum(F.when(is_task, F.coalesce(x, F.lit(0))).otherwise(0))
    n = lambda e: F.count_if(F.col("Event") == e)
    return events.groupBy("app").agg(
        part(m["Input Metrics"]["Bytes Read"]).alias("input_bytes"),
        part(m["Shuffle Read Metrics"]["Remote Bytes Read"]).alias("shuffle_read_bytes"),
        part(m["Shuffle Write Metrics"]["Shuffle Bytes Written"]).alias("shuffle_write_bytes"),
        part(m["Memory Bytes Spilled"]).alias("spilled_bytes"),
        n("SparkListenerJobStart").alias("n_jobs"),
        n("SparkListenerStageCompleted").alias("n_stages"),
        n("SparkListenerTaskEnd").alias("n_tasks"),
        F.count_if(is_task & F.col("`Task End Reason`.Failure").isNotNull()).alias("n_failed_tasks"),
    )


# The settings that a log is asked for, and their names in a report.
SETTINGS = {
    "spark.driver.memory": "driver_memory",
    "spark.driver.cores": "driver_cores",
    "spark.executor.memory": "executor_memory",
    "spark.executor.cores": "executor_cores",
    "spark.executor.instances": "executor_instances",
}


def event_config(events: DataFrame) -> DataFrame:
    """All settings by app (config), from its first environment update, and those of SETTINGS under their names."""
    own, older = F.col("`Spark Properties`"), F.col("`Environment Details`.`Spark Properties`")
    rows = _of(events, "EnvironmentUpdate").select(
        "app",
        "line_no",
        F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(older).alias("config")
    )
    first = rows.groupBy("app").agg(F.min_by("config", "line_no").alias("config"))
    return first.select("app", "config", *(F.element_at("config", k).alias(v) for k, v in SETTINGS.items()))


def event_stages(events: DataFrame) -> DataFrame:
    """Submitted stages with their completion, if any: state (submitted, completed), duration, failed tasks, failure, and
    what the accumulables say of input and shuffle write. A completion without a submission is left out; of several
    submissions the first counts, of completions the last."""
    s = F.col("`Stage Info`")
    began = _of(events, "StageSubmitted").select(
        "app",
        "line_no",
        s["Stage ID"].alias("stage"),
        F.coalesce(s["Stage Name"], s["Name"]).alias("name"),
        s["Number of Tasks"].alias("n_tasks"),
        s["Submission Time"].alias("start")
    )
    last = lambda word: F.element_at(
        F.filter(s["Accumulables"], lambda a: F.lower(a["Name"]).contains(word)),
        -1
    )["Value"].try_cast("long")
    summed = lambda word: F.when(F.size(F.filter(s["Accumulables"], lambda a: F.lower(a["Name"]).contains(word))) > 0, last(word))
    ended = _of(events, "StageCompleted").select(
        "app", "line_no", s["Stage ID"].alias("stage"), s["Submission Time"].alias("again"), s["Completion Time"].alias("end"), F.coalesce(s["Number of Failed Tasks"], F.lit(0)).alias("n_failed_tasks"),
        s["Failure Reason"].alias("failure"), summed("shuffle write").alias("shuffle_write_bytes"), summed("input").alias("input_bytes"), F.lit("completed").alias("state"),
    )
    out = _one(began, ["app", "stage"], F.min_by).join(_one(ended, ["app", "stage"], F.max_by), ["app", "stage"], "left")
    out = out.withColumn("duration_ms", F.col("end") - F.coalesce("again", "start")).drop("again")
    return out.fillna("submitted", ["state"]).fillna(0, ["n_failed_tasks"])


def event_jobs(events: DataFrame) -> DataFrame:
    """Started jobs with their end, if any: state (started, or the result), duration, stages and description."""
    began = _of(events, "JobStart").select(
        "app",
        "line_no",
        F.col("`Job ID`").alias("job"),
        F.col("`Submission Time`").alias("start"),
        F.col("`Stage IDs`").alias("stages"),
        F.substring("Description", 1, 100).alias("description")
    )
    ended = _of(events, "JobEnd").select(
        "app",
        "line_no",
        F.col("`Job ID`").alias("job"),
        F.col("`Completion Time`").alias("end"),
        F.coalesce("`Job Result`.Result", F.lit("unknown")).alias("state")
    )
    out = _one(began, ["app", "job"], F.min_by).join(_one(ended, ["app", "job"], F.max_by), ["app", "job"], "left")
    return out.fillna("started", ["state"]).withColumn("duration_ms", F.col("end") - F.col("start"))


def event_executors(events: DataFrame) -> DataFrame:
    """Executors by their last addition: host, cores, memory, when added, and when and why removed, if they were."""
    at, info = F.coalesce("Timestamp", "Time"), F.col("`Executor Info`")
    added = _of(events, "ExecutorAdded").select(
        "app",
        "line_no",
        F.col("`Executor ID`").alias("executor"),
        info["Host"].alias("host"),
        info["Total Cores"].alias("cores"),
        info["Memory"].alias("memory"),
        at.alias("added")
    )
    removed = _of(events, "ExecutorRemoved").select(
        "app",
        "line_no",
        F.col("`Executor ID`").alias("executor"),
        at.alias("removed"),
        F.coalesce("`Removed Reason`", F.lit("")).alias("reason")
    )
    out = _one(added, ["app", "executor"], F.max_by).join(_one(removed, ["app", "executor"], F.max_by), ["app", "executor"], "left")
    return out.withColumn("status", F.when(F.col("reason").isNull(), "active").otherwise("removed"))


def event_failures(events: DataFrame) -> DataFrame:
    """Failed tasks, stages and jobs of each app in one table: kind, id, stage, attempt, reason, executor, host and duration."""
    t, s, why = F.col("`Task Info`"), F.col("`Stage Info`"), F.col("`Task End Reason`")
    none = lambda kind: F.lit(None).cast(kind)

    def row(kind, id_, stage, attempt, reason, executor, host, duration):
        return [
            "app",
            F.lit(kind).alias("kind"),
            id_.alias("id"),
            stage.alias("stage"),
            attempt.alias("attempt"),
            reason.alias("reason"),
            executor.alias("executor"),
            host.alias("host"),
            duration.alias("duration")
        ]

    reason = F.coalesce(F.nullif(why["Failure"]["ClassName"], F.lit("")), why["Description"], F.lit(""))
    tasks = _of(events, "TaskEnd").filter(why["Failure"].isNotNull())
    tasks = tasks.select(
        *row(
            "task",
            t["Task ID"],
            F.col("`Stage ID`"),
            F.coalesce(t["Attempt"], F.lit(0)),
            reason,
            t["Executor ID"],
            t["Host"],
            F.coalesce(t["Duration"], F.lit(0))
        )
    )
    stages = _of(events, "StageCompleted").filter(s["Failure Reason"].isNotNull())
    stages = stages.select(
        *row("stage", s["Stage ID"], s["Stage ID"], none("long"), s["Failure Reason"], none("string"), none("string"), none("long"))
    )
    jobs = _of(events, "JobEnd").filter(F.col("`Job Result`.Result") != "JobSucceeded")
    jobs = jobs.select(
        *row("job", F.col("`Job ID`"), none("long"), none("long"), F.col("`Job Result`.Result"), none("string"), none("string"), none("long"))
    )
    return tasks.unionByName(stages).unionByName(jobs)


def app_rollup(executors: DataFrame, stages: DataFrame) -> DataFrame:
    """By app: executors, their memory, and sums over stages. executors(app, executor, max_memory_mb, peak_memory_mb)."""
    is_driver = F.col("executor") == "driver"
    e = executors.groupBy("app").agg(
        F.count_if(~is_driver).alias("n_executors"),
        F.sum(F.when(~is_driver, F.col("max_memory_mb"))).alias("total_memory_mb"),
        F.max(F.when(~is_driver, F.col("peak_memory_mb"))).alias("peak_memory_mb"),
        F.max(F.when(is_driver, F.col("max_memory_mb"))).alias("driver_memory_mb")
    )
    s = stages.groupBy("app").agg(*(F.sum(c).alias(c) for c in ("input_bytes", "shuffle_read_bytes", "shuffle_write_bytes", "spilled_bytes")))
    return e.join(s, "app", "full")


def merged_metrics(from_events: DataFrame, from_api: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """By app, what its event log says, and else what the API says."""
    a = from_events.select("app", *(F.col(c).alias(f"_a_{c}") for c in columns))
    b = from_api.select("app", *(F.col(c).alias(f"_b_{c}") for c in columns))
    return a.join(b, "app", "full").select("app", *(F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in columns))


def cached_totals(rdds: DataFrame) -> DataFrame:
    """By app: memory and disk of cached data, whether it spills, and the risk of running out of memory (in MB)."""
    out = rdds.groupBy("app").agg(F.count("*").alias("n_rdds"), F.sum("memory_mb").alias("memory_mb"), F.sum("disk_mb").alias("disk_mb"))
    risk = F.when(F.col("memory_mb") > 4096, "HIGH").when(F.col("memory_mb") > 2048, "MEDIUM").otherwise("LOW")
    return out.withColumn("spills", F.col("disk_mb") > 0).withColumn("oom_risk", risk)


def cached_skew(blocks: DataFrame, ratio: float = 3.0) -> DataFrame:
    """By app and RDD: skewed if two executors or more hold it and the most is over `ratio` medians."""
    out = blocks.groupBy("app", "rdd").agg(
        F.countDistinct("executor").alias("n_executors"),
        F.median("memory_mb").alias("median_mb"),
        F.max("memory_mb").alias("max_mb")
    )
    r = F.try_divide(F.col("max_mb"), F.col("median_mb"))
    return out.withColumn("ratio", r).withColumn("is_skewed", (F.col("n_executors") >= 2) & F.coalesce(r > ratio, F.lit(False)))


def report_totals(reports: DataFrame) -> DataFrame:
    """By workflow: stored reports, tokens used and characters of logs."""
    return reports.groupBy("workflow_code").agg(
        F.count("*").alias("n_reports"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.length("log_text")).alias("log_chars")
    )


def simple_timeout_cause(m: DataFrame) -> DataFrame:
    """A retried task first, then waiting of over twice the average, else unknown."""
    return m.withColumn(
        "cause",
        F.when(F.col("max_retry") > 0, "retry").when(F.col("max_wait") > 2 * F.col("avg_wait"), "queue_wait").otherwise("unknown")
    )


def timeout_advice(m: DataFrame) -> DataFrame:
    """What to do about a kind of timeout: fewer tasks at once, more of the queue, or more resources. Columns: timeout_type,
    running."""
    kind, most = F.col("timeout_type"), F.greatest(F.lit(5), 20 - F.coalesce("running", F.lit(10)))
    advice = F.when(
        kind == "cluster_overloaded",
        F.concat(F.lit("reduce_concurrency "), most.cast("string"))
    ).when(kind == "queue_congested", "adjust_queue_capacity +20%").when(kind.isin("memory_pressure", "vcore_pressure"), "add_resources")
    return m.withColumn("advice", advice)


# Errors for which a size is suggested.
RESOURCE_ERRORS = (
    "oom_executor",
    "oom_driver",
    "oom_driver_direct",
    "oom_offheap",
    "container_killed_memory",
    "gc_overhead",
    "shuffle_timeout",
    "shuffle_failed",
    "executor_lost_heartbeat",
    "driver_memory_insufficient",
    "executor_memory_insufficient",
)


def resource_suggestions(errors: DataFrame) -> DataFrame:
    """(alert_id, status, confidence, method, suggested_mb, suggested_instances) of errors of the resource kind.

    Columns: alert_id, error_type, executor_mb, instances, predicted_mb, spilled_mb, peak_mb, shuffle_mb, slots. With a
    shuffle the configuration is balanced to it; else the executor's memory follows the first of executor_memory()'s
    ways. Where the memory fits the shuffle already and it isn't memory that ran out, nothing is suggested.
    """
    c = F.col
    kind = c("error_type")
    e = errors.filter(kind.isin(*RESOURCE_ERRORS)).withColumn(
        "status",
        memory_use_status(c("executor_mb") * c("instances"), F.nullif("shuffle_mb", F.lit(0)))
    )
    e = e.filter((c("status") != "optimal") | kind.isin("oom_executor", "container_killed_memory", "gc_overhead"))
    sure = F.when(c("status") == "risky", "HIGH").when(c("status").isin("need_increase", "optimal"), "MEDIUM").when(
        c("status").isin("slightly_over", "over_configured") & kind.isin("oom_executor", "container_killed_memory"),
        "MEDIUM"
    ).otherwise("LOW")
    balanced = balanced_config(e.filter("shuffle_mb > 0").select(c("alert_id").alias("key"), "shuffle_mb")).select(
        c("key").alias("alert_id"),
        c("executor_memory_mb").alias("_mb"),
        c("executor_instances").alias("_n")
    )
    out = e.join(balanced, "alert_id", "left")
    other = executor_memory(c("executor_mb"), c("predicted_mb"), c("spilled_mb"), c("peak_mb"), c("shuffle_mb"), c("slots"))
    by_balance = c("_mb").isNotNull()
    return out.select(
        "alert_id",
        "status",
        sure.alias("confidence"),
        F.when(by_balance, "balanced_config").otherwise(other.method).alias("method"),
        F.when(by_balance, c("_mb")).otherwise(other.mb).cast("long").alias("suggested_mb"),
        c("_n").alias("suggested_instances")
    )


def sized_by_data(input_gb: Column, current_gb: Column, spilled: Column, shuffle_gb: Column) -> Column:
    """GB for an executor: 0.6 of the input or the present, half more after spills, plus 0.3 of the shuffle; at least
    half more than the present."""
    need = F.greatest(0.6 * input_gb, current_gb) * F.when(spilled, 1.5).otherwise(1.0) + 0.3 * shuffle_gb
    return F.greatest(need, 1.5 * current_gb)


# Errors by what is sized for them.
EXECUTOR_ERRORS = ("oom_executor", "container_killed_memory", "executor_memory_insufficient", "gc_overhead")
DRIVER_ERRORS = ("oom_driver", "driver_memory_insufficient")
TIMEOUT_ERRORS = ("shuffle_timeout", "network_timeout", "rpc_timeout")


def data_driven_changes(errors: DataFrame) -> DataFrame:
    """errors with changes, a map of settings sized by the data.

    Columns: error_type, config (a map of the present settings), input_bytes, shuffle_read_bytes, shuffle_write_bytes and
    spilled_bytes; nulls count as 0. Errors of no known kind get twice the executor memory.
    """
    gb = lambda c: F.coalesce(F.col(c), F.lit(0)) / float(1 << 30)
    now = lambda k, least: F.coalesce(memory_mb(F.element_at("config", k)), F.lit(least)).cast("long")
    executor, driver = now("spark.executor.memory", 1024), now("spark.driver.memory", 512)
    read, write = gb("shuffle_read_bytes"), gb("shuffle_write_bytes")
    need = F.greatest(0.6 * gb("input_bytes"), executor / 1024) * F.when(gb("spilled_bytes") > 0, 1.5).otherwise(1.0) + 0.3 * read
    executor_mb = F.greatest((need * 1024).cast("long"), (executor * 1.5).cast("long"))
    base = F.greatest(F.lit(2.0), driver / 1024)
    driver_mb = F.greatest((F.when(write > 1, write * 0.2 + base).otherwise(base) * 1024).cast("long"), (driver * 1.5).cast("long"))
    size, kind = memory_text_whole, F.col("error_type")
    changes = (
        F.when(kind.isin(*EXECUTOR_ERRORS), _settings({"spark.executor.memory": size(executor_mb), "spark.executor.memoryOverhead": size(F.greatest(F.floor(executor_mb / 4), F.lit(256)))}))
        .when(kind.isin(*DRIVER_ERRORS), _settings({"spark.driver.memory": size(driver_mb), "spark.driver.maxResultSize": size(F.least(F.floor(driver_mb / 2), F.lit(2048)))}))
        .when(kind == "oom_offheap", _settings({"spark.memory.offHeap.enabled": F.lit("true"), "spark.memory.offHeap.size": size((F.greatest(F.lit(2.0), read * 0.2) * 1024).cast("long"))}))
        .when(kind == "oom_storage", _settings({"spark.memory.storageFraction": F.lit("0.3")}))
        .when(kind.isin(*TIMEOUT_ERRORS), _settings({"spark.shuffle.io.timeout": F.when(read > 10, "300s").otherwise("120s"), "spark.network.timeout": F.when(read > 10, "600s").otherwise("300s")}))
        .when(kind == "executor_lost_heartbeat", _settings({"spark.executor.heartbeatInterval": F.lit("60s"), "spark.network.timeout": F.lit("300s")}))
        .otherwise(_settings({"spark.executor.memory": size(executor * 2), "spark.executor.memoryOverhead": size(F.floor(executor / 2))}))
    )
    return errors.withColumn("changes", changes)


def _settings(values: dict[str, Column]) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))


def quick_fix(error_type: Column) -> Column:
    """A change of settings for a timeout that is too short (half more) or a retry that is too fast (60 s); else null."""
    change = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    return F.when(error_type == "timeout_config_too_short", change("timeout", "x1.5")).when(
        error_type == "retry_config_too_aggressive",
        change("retry_interval", "60s")
    )
