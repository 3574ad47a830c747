"""Streams of alerts, approvals and feedback, with bounds on what is kept as state."""

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators import graph, match
from ..operators.alerts import enriched, is_alert, messages, normalised
from ..operators.review import candidate_key
from ..sources.store import Journal


def alert_stream(raw: DataFrame) -> DataFrame:
    """A stream of messages (raw) as normalised alerts; what isn't an alert is left out."""
    return normalised(messages(raw.filter(is_alert(F.col("raw")))))


def enriched_alerts(alerts: DataFrame, patterns: DataFrame, knowledge: DataFrame, index: DataFrame) -> DataFrame:
    """Alerts (alert_id, project, code, task_type, text) with their rule, knowledge and downstream impact."""
    logs = alerts.select(F.col("alert_id").alias("log_id"), "task_type", "text")
    classes = match.match_rules(logs, patterns).select(F.col("log_id").alias("alert_id"), "category", "error_type", "hint")
    known = match.match_knowledge(logs, knowledge).select(F.col("log_id").alias("alert_id"), "knowledge_id")
    impacts = graph.impact(alerts.select("alert_id", "project", "code"), index).select("alert_id", "n_downstream", "impact_source", "impact_level")
    return enriched(alerts, classes, known, impacts)


def enrich_stream(
    alerts: DataFrame,
    patterns: DataFrame,
    knowledge: DataFrame,
    index: DataFrame,
    write: Callable[[DataFrame, int], None]
) -> DataStreamWriter:
    """A writer that gives each micro-batch of alerts, enriched from static tables, to write(rows, batch number).

    The first matching rule of an alert is a ranking, which a stream can't do itself; within a batch it can. The batch number
    lets `write` replace what a batch that failed half-way has written.
    """
    return alerts.writeStream.foreachBatch(lambda batch, n: write(enriched_alerts(batch, patterns, knowledge, index), n))


def into_journal(journal: Journal, stream: str) -> Callable[[DataFrame, int], None]:
    """What enrich_stream() may write to: a batch of the stream that is run again is stored once."""
    return lambda rows, n: journal.append(rows, f"{stream}-{n:012d}")


def daily_metrics(instances: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by project and day, emitted when the watermark has passed the day; start_time may be without a zone."""
    timed = instances.withColumn("ts", F.col("start_time").cast("timestamp")).withWatermark("ts", late)
    by = timed.groupBy("project", F.window("ts", "1 day").alias("w"))
    return by.agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("state") == s).alias(s.lower()) for s in ("SUCCESS", "FAILURE", "RUNNING"))
    ).select("project", F.to_date("w.start").alias("day"), "total", "success", "failure", "running")


def _timed(rows: DataFrame, column: str, late: str) -> DataFrame:
    return rows.withColumn("ts", F.col(column).cast("timestamp")).withWatermark("ts", late)


def daily_type_metrics(instances: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts, failures and mean duration by project, day and task type."""
    by = _timed(instances, "start_time", late).groupBy("project", F.window("ts", "1 day").alias("w"), "task_type")
    out = by.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "FAILURE").alias("failure"), F.avg("duration").alias("avg_duration"))
    return out.select("project", F.to_date("w.start").alias("day"), "task_type", "total", "failure", "avg_duration")


class FirstExamples(StatefulProcessor):
    """Of a project, day and error type: the number of errors, their task types (a few), and the smallest few ids. Lists
    merge and are cut, so that the state stays small; it goes when the watermark has passed the day."""

    def __init__(self, examples: int):
        self.examples = examples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("errors", "kept string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, types, ids = json.loads(self.state.get()[0]) if self.state.exists() else (0, [], [])
        if not n:
            after = pd.Timestamp(key[1]) + pd.Timedelta(days=1)
            self.handle.registerTimer(max(int(after.timestamp() * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        for part in rows:
            n += len(part)
            types = sorted({*types, *part["task_type"].dropna()})
            ids = sorted([*ids, *part["id"].dropna()])[: self.examples]
        self.state.update((json.dumps((n, types, ids)),))
        yield pd.DataFrame({"project": [key[0]], "day": [key[1]], "error_type": [key[2]], "n": [n], "task_types": [types], "examples": [ids]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({c: [] for c in ("project", "day", "error_type", "n", "task_types", "examples")}, dtype=object)

    def close(self) -> None:
        pass


def daily_error_metrics(errors: DataFrame, late: str = "1 hour", examples: int = 3) -> DataFrame:
    """Counts by project, day and error type, with the task types (a few) and the first few ids as examples, as in batch.

    Each batch gives the keys that it changes. The session needs the RocksDB state store provider.
    """
    timed = _timed(errors, "start_time", late).select("project", F.to_date("ts").alias("day"), "error_type", F.col("id").cast("string").alias("id"), "task_type", "ts")
    return timed.groupBy("project", "day", "error_type").transformWithStateInPandas(
        statefulProcessor=FirstExamples(examples),
        outputStructType="project string, day date, error_type string, n long, task_types array<string>, examples array<string>",
        outputMode="Update",
        timeMode="EventTime"
    )


def audit_counts(audit: DataFrame, late: str = "1 hour") -> DataFrame:
    """Operations by day, result, risk and type."""
    by = _timed(audit, "timestamp", late).groupBy(F.window("ts", "1 day").alias("w"), "result", "risk_level", "operation_type")
    return by.count().select(F.to_date("w.start").alias("day"), "result", "risk_level", "operation_type", F.col("count").alias("n"))


def deduplicated(candidates: DataFrame, ts_col: str = "ts", late: str = "1 day") -> DataFrame:
    """The first of candidates with one (skill_name, original_log) within the watermark; the state holds a hash of them."""
    keyed = candidates.withColumn("_key", candidate_key())
    return keyed.withWatermark(ts_col, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


class LastExecution(StatefulProcessor):
    """Of a user and a span of time, the executions that its feedbacks can mean, and the feedbacks that wait.

    A feedback is answered when the watermark has passed it, as no earlier execution can come then; the span's state goes
    when the watermark has passed the span.
    """

    def __init__(self, seconds: int):
        self.range = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getListState("done", "at long, id string")
        self.asked = handle.getListState("asked", "at long, id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        soonest = timerValues.getCurrentWatermarkInMs() + 1
        self.handle.registerTimer(max((int(key[1]) + 1) * self.range // 1000 + 1, soonest))
        for part in rows:
            for r in part.itertuples():
                if r.kind == "execution":
                    self.done.appendValue((int(r.at), r.id))
                else:
                    self.asked.appendValue((int(r.at), r.id))
                    self.handle.registerTimer(max(int(r.at) // 1000 + 1, soonest))
        yield pd.DataFrame({c: [] for c in ("user", "feedback_id", "execution_id")}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        done, asked = sorted(self.done.get()), list(self.asked.get())
        out = []
        for at, feedback in asked:
            if at < passed:
                near = [x for x in done if at - self.range <= x[0] <= at]
                out.append((key[0], feedback, near[-1][1] if near else None))
        waiting = [x for x in asked if x[0] >= passed]
        if waiting:
            self.asked.put(waiting)
        else:
            self.asked.clear()
        if (int(key[1]) + 1) * self.range < passed:
            self.done.clear()
        yield pd.DataFrame(out, columns=["user", "feedback_id", "execution_id"], dtype=object)

    def close(self) -> None:
        pass


def feedback_pairs(feedbacks: DataFrame, executions: DataFrame, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """Each feedback (user, ts, feedback_id) with the user's last execution up to `seconds` before, null without one.

    Emitted when the watermark has passed, as a later execution may still come before. State is kept by user and span of
    `seconds`, and an execution counts in its span and the next, so that what is kept is bounded by the range and a user with
    many rows is spread. The session needs the RocksDB state store provider.
    """
    micros = F.unix_micros("ts")
    span = F.floor(micros / (seconds * 1_000_000))
    f = feedbacks.select("user", "ts", micros.alias("at"), F.lit("feedback").alias("kind"), F.col("feedback_id").cast("string").alias("id"), span.alias("span"))
    e = executions.select("user", "ts", micros.alias("at"), F.lit("execution").alias("kind"), F.col("execution_id").cast("string").alias("id"), F.explode(F.array(span, span + 1)).alias("span"))
    both = f.withWatermark("ts", late).unionByName(e.withWatermark("ts", late))
    return both.groupBy("user", "span").transformWithStateInPandas(
        statefulProcessor=LastExecution(seconds),
        outputStructType="user string, feedback_id string, execution_id string",
        outputMode="Append",
        timeMode="EventTime"
    )


class Approvals(StatefulProcessor):
    """A request is pending until its first decision in time or, by a timer in processing time, its expiry.

    A decision counts by its own time, not by when it is read: one that was made in time still decides a request that has
    timed out, and one that is read before its request waits for it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", "status string, expires_ms long, early string, early_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], timerValues.getCurrentProcessingTimeInMs()
        events = pd.concat(list(rows)).sort_values(["kind", "ts_ms"], ascending=[False, True])  # requests before decisions
        status, expires, early, early_ms = self.state.get() if self.state.exists() else (None, -1, None, -1)
        for r in events.itertuples():
            if r.kind == "request" and status is None:
                status, expires = "pending", int(r.expires_ms)
                out.append((key[0], status))
                if early is not None and early_ms <= expires:
                    status = early
                    out.append((key[0], status))
                else:
                    self.handle.registerTimer(max(expires, now + 1))
            elif r.kind == "decision" and status is None and early is None:
                early, early_ms = r.status, int(r.ts_ms)
            elif r.kind == "decision" and status in ("pending", "timeout"):
                new = r.status if int(r.ts_ms) <= expires else "timeout"
                if new != status:
                    status = new
                    out.append((key[0], status))
        self.state.update((status, expires, early, early_ms))
        yield pd.DataFrame(out, columns=["request_id", "status"], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, expires, early, early_ms = self.state.get() if self.state.exists() else (None, -1, None, -1)
        if status == "pending":
            self.state.update(("timeout", expires, early, early_ms))
            yield pd.DataFrame([(key[0], "timeout")], columns=["request_id", "status"], dtype=object)
        else:
            yield pd.DataFrame({"request_id": [], "status": []}, dtype=object)

    def close(self) -> None:
        pass


def approvals(events: DataFrame) -> DataFrame:
    """Changes of state (request_id, status) from events (request_id, kind, status, ts_ms, expires_ms); kind is
    `request` or `decision`.

    The session needs the RocksDB state store provider.
    """
    return events.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=Approvals(),
        outputStructType="request_id string, status string",
        outputMode="Update",
        timeMode="ProcessingTime"
    )
