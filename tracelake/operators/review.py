"""Review tables: candidates for new rules, and the knowledge that people confirm."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, generalised


def candidate_key() -> Column:
    """128 bits that stand for a candidate's skill and whole log; a null differs from an empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("skill_name", "original_log")]
    return F.md5(F.concat(F.length(parts[0]).cast("string"), *parts))


def first_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate for each (skill_name, original_log), the one with the smallest doc_id or, without, any."""
    key = [c for c in ("doc_id", "timestamp") if c in candidates.columns]
    if not key:
        return candidates.dropDuplicates(["skill_name", "original_log"])
    at = Window.partitionBy("skill_name", "original_log").orderBy(*key)
    return candidates.withColumn("_r", F.row_number().over(at)).filter("_r = 1").drop("_r")


def reviewed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates with the last decision (candidate_id, status, reviewed_by, reviewed_at, note) on each."""
    last = decisions.groupBy("candidate_id").agg(F.max_by(F.struct("status", "reviewed_by", "reviewed_at", "note"), "reviewed_at").alias("d"))
    out = candidates.join(last, "candidate_id", "left")
    return out.withColumn("status", F.coalesce("d.status", F.col("status"))).select(*candidates.columns, "d.reviewed_by", "d.reviewed_at", "d.note")


def merge_decisions(stored, decisions: DataFrame, batch: str) -> int | None:
    """Put decisions (candidate_id, status, reviewed_by, reviewed_at, note) into a store.KeyedTable by candidate_id; the
    latest of a candidate counts, in whatever order they come, and a batch that comes again changes nothing."""
    return stored.merge(decisions.select("candidate_id", "status", "reviewed_by", "reviewed_at", "note"), batch, "reviewed_at")


def pending(candidates: DataFrame) -> DataFrame:
    return candidates.filter("status = 'pending'")


def without_approved(candidates: DataFrame) -> DataFrame:
    return candidates.filter("status IS DISTINCT FROM 'approved'")


def status_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("skill_name").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("approved", "rejected", "pending")))


def confirm(entries: DataFrame, feedback: DataFrame) -> DataFrame:
    """Pending entries with their last feedback (id, feedback, suggestion, at): valid confirms, anything else rejects."""
    last = feedback.groupBy("id").agg(F.max_by(F.struct("feedback", "suggestion", "at"), "at").alias("f"))
    out = entries.join(last, "id", "left")
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("f.feedback") == "valid", "confirmed").when(F.col("f").isNotNull(), "rejected").otherwise("pending")
    return out.select(
        *(c for c in entries.columns if c != "status"),
        status.alias("status"),
        F.when((F.col("status") == "pending") & (status == "rejected"), F.col("f.suggestion")).alias("correction")
    )


def new_candidates(unmatched: DataFrame, least: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidates from unmatched logs (skill_name, original_log, confidence, and the columns to keep): excerpt and pattern,
    confident ones only."""
    short = excerpt(F.col("original_log"))
    sure = unmatched.withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).filter(F.col("confidence") >= least)
    return sure.select(
        *keep,
        "skill_name",
        F.substring("original_log", 1, 500).alias("original_log"),
        "confidence",
        short.alias("log_excerpt"),
        generalised(short).alias("suggested_pattern")
    )
