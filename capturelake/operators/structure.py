"""Structuring job: captures become notes, tasks, blocked or skipped rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions import rules as R
from capturelake.functions import text as T
from capturelake.functions.rx import blank_to_null, keep_rows
from capturelake.functions.scalars import at, journal_date, to_text_ts

from .classify import classify
from .merge import stable_id, top_per_key

CLOSED = ["blocked", "processed", "archived"]


def new_captures(df: DataFrame, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Captures by id, or the new ones, oldest first when a limit is set."""
    if ids is not None:
        return df.where(F.col("capture_id").isin(*ids))
    new = df.where(F.col("status") == "new")
    return new if limit is None else new.orderBy("created_at", "capture_id").limit(limit)


def route_captures(df: DataFrame, tokens: str | None = None) -> DataFrame:
    """Adds scores, note_type and route: skipped, blocked, task or note."""
    return classify(df, tokens=tokens).withColumn(
        "route",
        F.when(F.col("status").isin(*CLOSED), "skipped")
        .when(F.coalesce(F.col("pii_score"), F.lit(0.0)) >= R.RISK_HIGH, "blocked")
        .when(F.col("is_task"), "task")
        .otherwise("note"),
    )


def _routed_to(routed: DataFrame, route: str, stored: bool) -> DataFrame:
    """Rows of one route; a stored routed table is filtered in its scan."""
    test = F.col("route") == route
    return routed.where(test) if stored else keep_rows(routed, test)


def to_tasks(routed: DataFrame, as_of: datetime, stored: bool = False, title_chars: int | None = 120) -> DataFrame:
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    return _routed_to(routed, "task", stored).select(
        stable_id(F.lit("task"), "capture_id").alias("task_id"),
        F.col("capture_id").alias("source_capture_id"),
        F.lit(None).cast("string").alias("source_note_id"),
        T.task_title(text, title_chars).alias("title"),
        text.alias("details"),
        F.lit("todo").alias("status"),
        T.extract_priority(text).alias("priority"),
        *[F.lit(None).cast("string").alias(c) for c in ("due_at", "scheduled_at", "done_at")],
        F.lit("extracted").alias("source"),
        "sensitivity",
        at(as_of).alias("created_at"),
        at(as_of).alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def to_notes(
    routed: DataFrame, as_of: datetime, stored: bool = False, title_chars: int | None = 120, summary_chars: int | None = 160
) -> DataFrame:
    """Note rows; titles and summaries stay whole with ``None`` as their length."""
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    journal = F.col("note_type") == "journal"
    base = (
        _routed_to(routed, "note", stored)
        .withColumn("_occurred", to_text_ts(F.coalesce("occurred_at", "created_at")))
        .withColumn("_url", T.extract_url(text))
    )
    without_url = F.when(F.col("_url").isNull(), text).otherwise(
        F.coalesce(blank_to_null(T.strip_urls(text)), text)
    )
    return base.select(
        stable_id(F.lit("note"), "capture_id").alias("note_id"),
        F.col("capture_id").alias("source_capture_id"),
        "note_type",
        T.note_title(text, F.concat(F.col("note_type"), F.lit(" note")), title_chars).alias("title"),
        T.clamp(without_url, summary_chars).alias("summary"),
        text.alias("body"),
        F.col("_occurred").alias("occurred_at"),
        F.when(journal, journal_date("_occurred")).alias("journal_date"),
        F.when(journal, T.extract_score(text, R.MOOD)).alias("mood_score"),
        F.when(journal, T.extract_score(text, R.ENERGY)).alias("energy_score"),
        F.when(F.col("note_type") == "learning", F.col("_url")).alias("source_url"),
        "source_id",
        "sensitivity",
        F.lit("active").alias("review_status"),
        at(as_of).alias("created_at"),
        at(as_of).alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def flag_reuse(new: DataFrame, existing: DataFrame, id_col: str) -> DataFrame:
    """New rows with ``active_id``, the active row of the same capture that is reused, null where the row is to insert.

    Of several active rows of a capture, the one with the smallest id is reused.
    """
    active = top_per_key(existing.where(F.col("deleted_at").isNull()), ["source_capture_id"], [F.asc(id_col)]).select(
        "source_capture_id", F.col(id_col).alias("active_id")
    )
    return new.join(active, "source_capture_id", "left")


def reuse_active(new: DataFrame, existing: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, capture -> id map): an active row is reused, not doubled."""
    looked = flag_reuse(new, existing, id_col)
    inserts = looked.where(F.col("active_id").isNull()).select(*new.columns)
    return inserts, looked.select("source_capture_id", F.coalesce("active_id", id_col).alias(id_col))


def reuse_counts(flagged: DataFrame) -> DataFrame:
    """One row: offered, inserted and reused of a flagged frame."""
    return flagged.agg(
        F.count(F.lit(1)).alias("offered"),
        F.count_if(F.col("active_id").isNull()).alias("inserted"),
        F.count_if(F.col("active_id").isNotNull()).alias("reused"),
    )


def mark_captures(
    routed: DataFrame,
    as_of: datetime,
    note_ids: DataFrame | None = None,
    task_ids: DataFrame | None = None,
) -> DataFrame:
    """Capture snapshot after the run: status and parsed ids filled in.

    A projection of the routed captures; only reused ids need a join, so the
    maps of ``reuse_active`` are optional.
    """
    out = routed
    for kind, ids in (("note", note_ids), ("task", task_ids)):
        made = stable_id(F.lit(kind), "capture_id")
        if ids is not None:
            known = ids.select(F.col("source_capture_id").alias("capture_id"), F.col(f"{kind}_id").alias(f"_{kind}_known"))
            out = out.join(known, "capture_id", "left")
            made = F.coalesce(F.col(f"_{kind}_known"), made)
        old = F.col(f"parsed_{kind}_id") if f"parsed_{kind}_id" in routed.columns else F.lit(None).cast("string")
        out = out.withColumn(f"parsed_{kind}_id", F.when(F.col("route") == kind, made).otherwise(old))
    touched = F.col("route") != "skipped"
    old_time = F.col("updated_at") if "updated_at" in routed.columns else F.lit(None).cast("timestamp")
    return (
        out.withColumn("updated_at", F.when(touched, at(as_of)).otherwise(old_time))
        .withColumn(
            "status",
            F.when(F.col("route") == "blocked", "blocked").when(touched, "processed").otherwise(F.col("status")),
        )
        .drop("route", "is_task", "note_type", "_note_known", "_task_known", *[f"score_{x}" for x in R.CLASS_LABELS])
    )


def structure_counts(routed: DataFrame, dry_run: bool = False) -> DataFrame:
    """One result row; processed = notes + tasks + blocked."""
    by_route = {r: F.count_if(F.col("route") == r) for r in ("note", "task", "blocked", "skipped")}
    return routed.agg(
        (by_route["note"] + by_route["task"] + by_route["blocked"]).alias("captures_processed"),
        by_route["note"].alias("notes_created"),
        by_route["task"].alias("tasks_created"),
        by_route["blocked"].alias("captures_blocked"),
        by_route["skipped"].alias("captures_skipped"),
        F.count_if(F.col("route").isNull()).alias("errors"),
    ).withColumn("dry_run", F.lit(dry_run))
