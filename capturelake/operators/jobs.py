"""Analysis jobs, their items and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.rx import ColumnOrName, as_col
from capturelake.functions.text import strip

from .merge import latest_per_key, top_per_key
from .usage import bounded

FAILED = ["failed", "blocked", "queued"]


def map_entry_state(status: ColumnOrName) -> Column:
    """Entry analysis state of a job-item status."""
    s = as_col(status)
    known = s.isin("queued", "running", "succeeded", "failed", "blocked")
    return F.when(known, s).otherwise("not_requested")


def map_result_status(status: ColumnOrName) -> Column:
    """Result status of a worker status."""
    s = as_col(status)
    return F.when(s == "queued", "queued_retry").when(s == "failed", "error").otherwise(s)


def shown_item_status(status: ColumnOrName) -> Column:
    s = as_col(status)
    return F.when(s == "queued", "queued_retry").otherwise(s)


def latest_status(items: DataFrame, tie: str = "item_id") -> DataFrame:
    return latest_per_key(items, ["entry_id"], ["updated_at", tie]).select(
        "entry_id", F.col("status").alias("analysis_status")
    )


def with_latest_status(entries: DataFrame, items: DataFrame, tie: str = "item_id") -> DataFrame:
    return entries.join(latest_status(items, tie), "entry_id", "left")


def job_counters(items: DataFrame) -> DataFrame:
    counted = items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded_items"),
        F.count_if(F.col("status").isin(*FAILED)).alias("failed_items"),
    )
    return counted.withColumn("final_status", F.when(F.col("failed_items") > 0, "failed").otherwise("succeeded"))


def list_jobs(
    jobs: DataFrame,
    items: DataFrame,
    extractions: DataFrame,
    status: str | None = None,
    limit: int | None = None,
    job_id=None,
) -> DataFrame:
    """Newest jobs, one row per item with its latest extraction.

    The jobs shown restrict the items, and these the extractions before the
    window.  One job is looked up among all jobs.
    """
    page = jobs if status is None else jobs.where(F.col("status") == status)
    newest = page if job_id is None else page.where(F.col("job_id") == job_id)
    if limit is not None:
        newest = newest.orderBy(F.desc("requested_at"), F.desc("job_id")).limit(limit)
    shown = newest.select("job_id", F.col("status").alias("job_status"), "requested_at")
    mine = items.join(shown.select("job_id"), "job_id", "left_semi")
    made = extractions.join(mine.select(F.col("item_id").alias("job_item_id")), "job_item_id", "left_semi")
    latest = top_per_key(made, ["job_item_id"], [F.desc("created_at"), F.desc("extraction_id")]).select(
        F.col("job_item_id").alias("item_id"), "extraction_id", "model"
    )
    detailed = mine.join(latest, "item_id", "left").select(
        "job_id",
        "item_id",
        "entry_id",
        shown_item_status("status").alias("item_status"),
        F.col("created_at").alias("item_created_at"),
        "extraction_id",
        "model",
    )
    return shown.join(detailed, "job_id", "left")


def job_entries(jobs: DataFrame, items: DataFrame, from_ts: str | None = None, to_ts: str | None = None) -> DataFrame:
    """Distinct (job, entry) pairs of the jobs requested in a range."""
    shown = bounded(jobs, "requested_at", from_ts, to_ts).select("job_id", "requested_at")
    pairs = items.select("job_id", "entry_id").distinct()
    return shown.join(pairs, "job_id")


def job_history(
    jobs: DataFrame,
    items: DataFrame,
    claims: DataFrame,
    entries: DataFrame,
    from_ts: str | None = None,
    to_ts: str | None = None,
    per_entry: int | None = None,
) -> DataFrame:
    """History rows: job, entry, preview and how many claims are shown."""
    pairs = job_entries(jobs, items, from_ts, to_ts)
    found = F.count(F.lit(1))
    shown = claims.where(F.col("deleted_at").isNull()).groupBy("entry_id").agg(
        (found if per_entry is None else F.least(found, F.lit(per_entry))).alias("claims_shown")
    )
    text = strip(F.coalesce(F.col("body"), F.lit("")))
    previews = entries.select("entry_id", F.when(text != "", text).otherwise(F.col("payload")).alias("preview"))
    return (
        pairs.join(shown, "entry_id", "left")
        .join(previews, "entry_id", "left")
        .withColumn("claims_shown", F.coalesce("claims_shown", F.lit(0)))
    )


def fold_attempts(attempts: DataFrame) -> DataFrame:
    """Item state after all its attempts: last status and attempt count.

    ``attempts`` has item_id, attempt_no, worker_status, claims_inserted,
    error, finished_at.  One aggregate; the last attempt travels as a struct.
    """
    state = F.when(F.col("worker_status").isin("succeeded", "blocked", "queued"), F.col("worker_status")).otherwise("failed")
    last = F.max(F.struct("finished_at", "attempt_no", state.alias("status"), "claims_inserted", "error"))
    folded = attempts.groupBy("item_id").agg(last.alias("l"), F.count(F.lit(1)).alias("attempt_count"))
    fallback = (
        F.when(F.col("l.status") == "blocked", "blocked_sensitive")
        .when(F.col("l.status") == "queued", "queued_retry")
        .otherwise("analysis failed")
    )
    return folded.select(
        "item_id",
        F.col("l.status").alias("status"),
        "attempt_count",
        F.col("l.claims_inserted").alias("claims_inserted"),
        F.when(F.col("l.status") != "succeeded", F.coalesce(F.col("l.error"), fallback)).alias("last_error"),
        F.when(F.col("l.status") == "queued", F.col("l.finished_at") + F.expr("INTERVAL 5 MINUTES")).alias("next_retry_at"),
    )
